"""Mixing sources to target weights, with DataFrame operations only.

The words of each source are packed, in a fixed order, into blocks of BLOCK_WORDS words. The mix is a row of slots of one block
each, cut into output shards. Each shard draws how many of its slots go to which source: slot j of m takes a uniform number
of its own from the j-th of m equal strata, and the source whose share of the unit interval holds it (a stratified draw from
the multinomial, with far less spread than independent ones). A source's slots, counted through all shards, run through
pseudorandom permutations of its block numbers (a swap-or-not shuffle, keyed by seed, source and pass), so that no block
comes up a second time before all others have come up. Slots meet blocks by (source, block number).

Targets: weights share out all words; a source's target stops at MAX_REPEATS times its words, and the excess is shared again
by weight. That ends with targets min(MAX_REPEATS size, c weight) for one c, found with a running sum over the sources.

Defined results. Null text has 0 words. A row without words takes nothing. A null source is a source of its own, the last.
Rows that repeat a doc_id, or lack one, count on their own. Very long texts are split over many blocks. Ties: a source's rows lie in
the order of doc_id (nulls last), a hash of the text, size; equal rows are interchangeable. An empty table gives no rows. Reruns agree
whatever the partitions. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK_WORDS = 32
SHARD_SLOTS = 65_536
#: Rounds of the swap-or-not shuffle.
ROUNDS = 12
SEED = 20_240_229
#: Rows of one source that are ordered in one task, and slots that one task permutes, about.
ROWS_IN_ORDER, SLOTS_IN_TASK = 20_000, 1 << 20


def _uniform(*keys) -> Column:
    """A number from [0, 1) that depends on the keys alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11) / F.lit(float(1 << 53))


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("hash"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """sid (0, 1, ...), source, source_size, target: one row a source. Only this table, a row a source, is ordered as a whole."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("sid", F.row_number().over(by_name).cast("long") - 1)
    s = s.withColumn("weight", F.element_at(F.lit(list(weights)), (F.col("sid") % len(weights) + 1).cast("int"))).withColumn("most", MAX_REPEATS * F.col("source_size"))
    # In order of most/weight, the sources that stop come first; c is what is left to share over the weight left.
    order = Window.orderBy(F.col("most") / F.col("weight"), "sid")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0)))
    s = s.withColumn("weight_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("c", F.max(F.when(F.col("left") * F.col("weight") <= F.col("most") * F.col("weight_left"), F.col("left") / F.col("weight_left"))).over(everything))
    target = F.when(F.col("most") <= F.col("c") * F.col("weight"), F.col("most").cast("double")).otherwise(F.col("c") * F.col("weight"))
    return s.select("sid", "source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def packed(sizes: DataFrame, sources: DataFrame, n_rows: int) -> DataFrame:
    """sizes with sid, source_size, target and start, the row's place among its source's words; a hot source is ordered in parts."""
    parts = max(1, n_rows // ROWS_IN_ORDER)
    rows = sizes.join(sources, sizes.source.eqNullSafe(sources.source)).select("sid", "doc_id", "size", "hash", "source_size", "target", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(parts)).alias("part"))
    sums = rows.groupBy("sid", "part").agg(F.sum("size").alias("words"))
    starts = sums.select("sid", "part", (F.sum("words").over(Window.partitionBy("sid").orderBy("part")) - F.col("words")).alias("part_start"))
    within = F.sum("size").over(Window.partitionBy("sid", "part").orderBy(F.col("doc_id").asc_nulls_last(), "hash", "size").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within - F.col("size")).join(starts, ["sid", "part"]).withColumn("start", F.col("part_start") + F.col("within")).drop("within", "part", "part_start")


def slots(sources: DataFrame) -> DataFrame:
    """(sid, block) of every slot of the mix."""
    spark = sources.sparkSession
    shares = sources.where("source_size > 0").withColumn("blocks", F.ceil(F.col("source_size") / BLOCK_WORDS))
    shares = shares.withColumn("expected", F.col("target") * F.col("blocks") / F.col("source_size"))  # slots: the last block of a source is short
    # Summed in order, and all of it taken from there: the same number each time.
    shares = shares.withColumn("sum", F.sum("expected").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0)))
    shares = shares.withColumn("all_slots", F.max("sum").over(Window.partitionBy())).withColumn("upto", F.col("sum") / F.col("all_slots"))
    shares = shares.withColumn("from", F.coalesce(F.lag("upto").over(Window.orderBy("sid")), F.lit(0.0))).withColumn("upto", F.when(F.row_number().over(Window.orderBy(F.desc("sid"))) == 1, F.lit(2.0)).otherwise(F.col("upto")))
    shares, _ = written(shares.select("sid", "blocks", "from", "upto", "all_slots"), "shares")
    first = shares.agg(F.max("all_slots"), F.count("*")).first()
    n_slots, cells = round(first[0] or 0), 4 * max(first[1], 64)
    shards = -(-n_slots // SHARD_SLOTS)
    # A grid over the unit interval turns "which source's interval holds the number" into a join by cell.
    grid = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("from") * cells), F.least(F.floor(F.col("upto") * cells), F.lit(cells - 1))))).select("sid", "from", "upto", "cell")
    in_shard = F.when(F.col("shard") < shards - 1, F.lit(SHARD_SLOTS)).otherwise(F.lit(n_slots - max(shards - 1, 0) * SHARD_SLOTS))
    drawn = spark.range(n_slots).select("id", F.floor(F.col("id") / SHARD_SLOTS).alias("shard")).withColumn("u", (F.col("id") % SHARD_SLOTS + _uniform(F.lit("slot"), F.col("id"))) / in_shard)
    drawn = drawn.withColumn("cell", F.least(F.floor(F.col("u") * cells), F.lit(cells - 1))).join(grid, "cell").where(F.expr("u >= `from` and u < upto"))
    counts, _ = written(drawn.groupBy("sid", "shard").agg(F.count("*").alias("n")), "counts")
    before = F.sum("n").over(Window.partitionBy("sid").orderBy("shard")) - F.col("n")
    # A row a source and shard is little, but stands for up to SHARD_SLOTS slots: these are dealt out before they are made.
    tasks = max(1, -(-n_slots // SLOTS_IN_TASK), min(shards, 2 * spark.sparkContext.defaultParallelism))
    ordinal = counts.withColumn("before", before).repartition(tasks, "shard", "sid").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    ordinal = ordinal.select("sid", (F.col("before") + F.col("k")).alias("k"))
    x = ordinal.join(shares.select("sid", "blocks"), "sid").where(F.col("k") < MAX_REPEATS * F.col("blocks"))
    x = x.select("sid", "blocks", F.floor(F.col("k") / F.col("blocks")).alias("pass"), (F.col("k") % F.col("blocks")).alias("block"))
    return x.select("sid", F.aggregate(F.lit(list(range(ROUNDS))), F.col("block"), _swapped).alias("block"))


def _swapped(at: Column, r: Column) -> Column:
    """A round of the shuffle: a point and its partner K - point change places, or don't, by a bit that depends on the pair."""
    partner = F.pmod(F.pmod(F.xxhash64(F.lit(SEED), r, "sid", "pass"), F.col("blocks")) - at, F.col("blocks"))
    swap = F.xxhash64(F.lit(-SEED), r, "sid", "pass", F.greatest(at, partner)).bitwiseAND(F.lit(1)) == 1
    return F.when(swap, partner).otherwise(at)


def _taken(docs: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """doc_id, hash (of the text), size, source_size, target, taken, a row for each row of docs."""
    sizes, _ = written(sized(docs), "sizes")
    sources, _ = written(targets(sizes, weights), "sources")
    rows = packed(sizes, sources, sizes.count())
    parts = rows.withColumn(
        "block",
        F.explode_outer(F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / BLOCK_WORDS), F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)))),
    )
    overlap = F.least((F.col("block") + 1) * BLOCK_WORDS, F.col("start") + F.col("size")) - F.greatest(F.col("block") * BLOCK_WORDS, F.col("start"))
    draws = slots(sources).groupBy("sid", "block").agg(F.count("*").alias("draws"))
    taken = parts.withColumn("words", F.coalesce(overlap, F.lit(0))).join(draws, ["sid", "block"], "left")
    key = ["sid", "start", "doc_id", "hash", "size", "source_size", "target"]
    whole = taken.where("size > 0").groupBy(key).agg(F.sum(F.col("words") * F.coalesce("draws", F.lit(0))).alias("taken"))
    columns = ["doc_id", "hash", "size", "source_size", "target", "taken"]
    return whole.select(columns).unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("long")).select(columns))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken, a row for each row of docs."""
    return _taken(docs, weights).drop("hash")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as whole documents: each comes taken/size times, rounded up or down by a number drawn from its doc_id and text.

    Rows that share doc_id and text (also without doc_id) come equally often, by the mean of their shares. Rows without words never come. A null source is a
    source of its own. An empty table gives no rows. All columns are returned as they came, whatever their names.
    """
    row = _taken(docs, WEIGHTS).groupBy("doc_id", "hash").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("times")).where("times > 0")
    copies = F.floor(F.col("times") + _uniform(F.lit("copies"), F.col("doc_id"), F.col("hash")))
    row = row.select(F.col("doc_id").alias("_mixed_id"), F.col("hash").alias("_mixed_hash"), copies.alias("_copies")).where("_copies > 0")
    found = docs.join(row, docs["doc_id"].eqNullSafe(row["_mixed_id"]) & (F.xxhash64(docs["text"]) == row["_mixed_hash"]))
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select([docs[c] for c in docs.columns])
