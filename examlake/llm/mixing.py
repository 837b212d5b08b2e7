"""Mixing sources to target weights, with DataFrame functions only.

1. Targets: sources in order of code points (null last) weigh 3, 1, 2, repeating, and share ``share`` of all words; a
   target stops at ``most`` times its source's size and the excess goes to the others by weight (water filling: in
   order of size over weight, the sources that reach their limit come first, so one pass over the sources settles it).
2. Packing: the texts of a source, in a hashed order, are one stream of words cut in blocks of ``BLOCK`` words. Places in
   the stream are sums over buckets of about ``BUCKET`` texts, then over buckets, so no source is ever one task.
3. Each source has a quota of slots that takes its target; all slots lie in output shards of ``SHARD`` slots. Every slot draws
   a source by its quota's share, so a shard's counts of the sources are one multinomial draw. The counts number the
   slots: those of a source in its first shard come first, and so on. Slots that a source was drawn for beyond its quota
   go to the sources that were drawn too seldom, in order, so that targets are met and no text is taken too often.
4. Slot k of a source takes block p(k mod blocks), where p is a swap-or-not permutation (Hoang, Morris and Rogaway, 2012) of
   the block numbers, keyed by the source: a bijection on any number of blocks, without a table.
   So each block is taken k div blocks times or once more, and never more than ``most`` times.
5. Slots and blocks are joined by index; a text takes what its parts of the blocks are taken.

Defined results: null and blank texts have size 0 and take nothing; null is a source of its own, the last; a source of
size 0 has target 0; repeated rows are texts of their own (rows that agree in id and text take the mean of what they take together);
an empty table gives an empty one; the same input gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from examlake.llm.shared import written

BLOCK, BUCKET, ROUNDS = 128, 4096, 24
#: Slots of an output shard, shards whose counts are summed at once, numbers of one cell of a draw, and cells made of one row.
SHARD, SHARDS, CELL, CELLS = 8192, 1024, 64, 1 << 16
WEIGHTS = (3, 1, 2)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) with target, one row for each source."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    by_limit = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, every = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(0))
    limited = F.lit(most) * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    # what a unit of weight gets if exactly the sources before this one are at their limits
    unit = ((F.lit(share) * F.sum("source_size").over(every) - limited) / F.sum("weight").over(rest)).alias("unit")
    settled = ranked.select("*", unit).withColumn("free", F.lit(most) * F.col("source_size") > F.col("unit") * F.col("weight"))
    level = settled.withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("unit")))).over(every))
    return level.select(*sources.columns, "weight", F.when(F.col("level").isNull(), F.lit(most) * F.col("source_size")).otherwise(F.least(F.lit(most) * F.col("source_size"), F.col("level.unit") * F.col("weight"))).alias("target"))


def permuted(k: Column, n: Column, key: Column) -> Column:
    """A keyed permutation of 0 .. n-1: rounds of swap-or-not, each of which pairs the numbers and swaps a pair or not."""

    def swap(k: Column, r: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(key, r), n) - k, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(k, partner)), F.lit(2)) == 1, partner).otherwise(k)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k.cast("long"), swap)


def _segments(texts: DataFrame) -> DataFrame:
    """Rows (source_key, block, row, start, words) of the parts of texts that lie in each block. ``texts``: row, source_key, words, buckets."""
    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("row", F.lit(7)), F.col("buckets")))
    in_bucket = Window.partitionBy("source_key", "bucket").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("source_key", "bucket").agg(F.sum("words").alias("sum")).select("source_key", "bucket", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    placed = dealt.withColumn("within", F.coalesce(F.sum("words").over(in_bucket), F.lit(0))).join(base, ["source_key", "bucket"]).withColumn("at", F.col("base") + F.col("within"))
    first, last = F.floor(F.col("at") / BLOCK), F.floor((F.col("at") + F.col("words") - 1) / BLOCK)
    cut = placed.select("row", "source_key", "at", "words", F.explode(F.sequence(first, last)).alias("block"))
    start = F.greatest(F.col("at"), F.col("block") * BLOCK)
    return cut.select("source_key", "block", "row", (start - F.col("at")).alias("start"), (F.least(F.col("at") + F.col("words"), (F.col("block") + 1) * BLOCK) - start).alias("words"))


def _cells(parts: DataFrame, start: str, size: str) -> DataFrame:
    """``parts`` (each has the numbers from ``start`` on, ``size`` of them) by the cells of ``CELL`` numbers that they touch. As no part is empty, a cell has ``CELL`` parts at most.

    A part is cut in ranges of ``CELLS`` cells first, which are dealt to tasks, so that no row holds more than one range however large the part is.
    """
    parts = parts.filter(F.col(size) > 0).withColumn("last", F.floor((F.col(start) + F.col(size) - 1) / CELL))
    ranges = parts.withColumn("from_cell", F.explode(F.sequence(F.floor(F.col(start) / CELL), F.col("last"), F.lit(CELLS).cast("long"))))
    ranges = ranges.repartition(F.col(start), F.col("from_cell"))
    return ranges.withColumn("cell", F.explode(F.sequence(F.col("from_cell"), F.least(F.col("from_cell") + (CELLS - 1), "last")))).drop("from_cell", "last")


def _within(numbers: DataFrame, number: str, cells: DataFrame, start: str, size: str) -> DataFrame:
    """Each row of ``numbers`` with the part that holds its number: joined by cell, so that a large part is many keys."""
    hit = numbers.withColumn("cell", F.floor(F.col(number) / CELL)).join(cells, "cell")
    return hit.filter((F.col(number) >= F.col(start)) & (F.col(number) < F.col(start) + F.col(size))).drop("cell")


def shard_counts(quotas: DataFrame, seed: int = 1) -> DataFrame:
    """(shard, source_key, drawn): how many slots of each shard draw each source. ``quotas``: source_key and slots."""
    in_order = Window.partitionBy(F.lit(0)).orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    parts = quotas.filter("slots > 0").select("source_key", "slots", F.coalesce(F.sum("slots").over(in_order), F.lit(0)).alias("from"))
    total = quotas.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    slots = quotas.sparkSession.range(0, total, 1, max(1, -(-total // (8 * SHARD)))).select(F.floor(F.col("id") / SHARD).alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit(11), "id"), F.lit(max(total, 1))).alias("draw"))
    return _within(slots, "draw", _cells(parts, "from", "slots"), "from", "slots").groupBy("shard", "source_key").agg(F.count("*").alias("drawn"))


def _numbered(counts: DataFrame) -> DataFrame:
    """``counts`` with first: the number of the source's first slot in the shard. Sums over ``SHARDS`` shards, then over those."""
    near = counts.withColumn("group", F.floor(F.col("shard") / SHARDS))
    own = Window.partitionBy("source_key", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("source_key").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    base = near.groupBy("source_key", "group").agg(F.sum("drawn").alias("sum")).select("source_key", "group", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    first = F.col("base") + F.coalesce(F.sum("drawn").over(own), F.lit(0))
    return near.join(base, ["source_key", "group"]).select("shard", "source_key", "drawn", first.alias("first"))


def _settled(counts: DataFrame, quotas: DataFrame) -> DataFrame:
    """(shard, source_key, blocks, slot): numbered slots, exactly as many of each source as its quota. ``quotas``: source_key, blocks and slots."""
    numbered = written(_numbered(counts))
    sums = quotas.select("source_key", "blocks", "slots").join(numbered.groupBy("source_key").agg(F.sum("drawn").alias("drawn")), "source_key", "left").na.fill(0)
    over, lack = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    in_order = Window.partitionBy(F.lit(0)).orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    of = sums.select("source_key", "blocks", "slots", "drawn", lack.alias("lack"), F.coalesce(F.sum(over).over(in_order), F.lit(0)).alias("over_from"), F.coalesce(F.sum(lack).over(in_order), F.lit(0)).alias("lack_from"))
    of = written(of)
    run = lambda low, high: F.explode(F.sequence(low, high - 1))
    total = numbered.agg(F.coalesce(F.sum("drawn"), F.lit(0))).first()[0]
    runs = numbered.join(of.select("source_key", "blocks", "slots", "over_from"), "source_key").withColumn("end", F.col("first") + F.col("drawn"))
    runs = runs.repartition(max(1, -(-total // (8 * SHARD))), "shard", "source_key")  # few rows here are many slots
    kept = runs.filter(F.col("first") < F.col("slots")).select("shard", "source_key", "blocks", run(F.col("first"), F.least("end", "slots")).alias("slot"))
    beyond = runs.filter(F.col("end") > F.col("slots")).select("shard", (F.col("over_from") - F.col("slots") + F.col("first")).alias("shift"), F.greatest(F.lit(0).cast("long"), F.col("slots") - F.col("first")).alias("skip"), "drawn")
    beyond = beyond.select("shard", "shift", run(F.col("skip"), F.col("drawn")).alias("i")).select("shard", (F.col("shift") + F.col("i")).alias("number"))
    lacking = _cells(of.select("source_key", "blocks", "drawn", "lack", "lack_from"), "lack_from", "lack")
    moved = _within(beyond, "number", lacking, "lack_from", "lack").select("shard", "source_key", "blocks", (F.col("drawn") + F.col("number") - F.col("lack_from")).alias("slot"))
    return kept.unionAll(moved)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, slots, segments).

    texts: row, ``id_col``, size, source, source_size and target of every row of ``docs``.
    slots: the mix itself: source_key, shard, slot, epoch and block.
    segments: source_key, block, row, start and words: the part of a text that lies in a block.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col), F.col(source_col)).alias("row"))
    named = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))  # null is a source of its own
    base = written(base.withColumn("source_key", named))
    sources = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("texts"))
    goal = targets(sources).withColumn("source_key", named).withColumn("blocks", F.ceil(F.col("source_size") / BLOCK))
    count = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long")
    goal = written(goal.withColumn("slots", count).withColumn("buckets", F.greatest(F.ceil(F.col("texts") / BUCKET), F.lit(1))))

    joined = base.join(goal.select("source_key", "source_size", "target", "buckets"), "source_key")
    texts = joined.select("row", F.col("id").alias(id_col), "size", "source", "source_size", "target")
    segments = _segments(joined.filter("size > 0").groupBy("row", "source_key", "buckets").agg(F.sum("size").alias("words")))

    key = F.xxhash64(F.lit(seed), F.col("source_key"))
    slots = _settled(shard_counts(goal, seed), goal)
    slots = slots.select("source_key", "shard", "slot", F.floor(F.col("slot") / F.col("blocks")).alias("epoch"), permuted(F.col("slot") % F.col("blocks"), F.col("blocks"), key).alias("block"))
    return texts, slots, segments


def taken(texts: DataFrame, slots: DataFrame, segments: DataFrame) -> DataFrame:
    """``texts`` with taken, the words that the mix takes of each, repeats counted."""
    often = slots.groupBy("source_key", "block").agg(F.count("*").alias("times"))
    by_row = segments.join(often.hint("shuffle_hash"), ["source_key", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("all"))
    same = texts.groupBy("row").agg(F.count("*").alias("alike")).join(by_row, "row").select("row", F.floor(F.col("all") / F.col("alike")).cast("long").alias("taken"))
    return texts.join(same, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
