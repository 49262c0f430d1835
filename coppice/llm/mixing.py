"""Mixing sources to target weights, with DataFrame operations only.

The words of each source form one stream (documents in order of a hash), cut into blocks of
fixed length. The output is a sequence of slots, one block each, grouped into shards. How many
slots of a shard each source gets is a multinomial draw, conditioned on the sources' totals so
that every source meets its target: a pseudorandom permutation of all slots places the sources'
slots in the output. A source's i-th slot maps to a block by a pseudorandom permutation of its
block numbers, a new one for each epoch (i div number of blocks), and is joined with the
blocks by number. A block is used at most ceil(target / size) times.

The permutations are swap-or-not networks: no table, no sort, and the same on every rerun.
Offsets in the streams are sums over hash buckets first and within buckets second, so that no
task has to order a whole source. Nothing but the slot total and the row count reaches the driver.

Null and empty texts have size 0 and take nothing. A null source is a source, last in order.
Repeated rows are documents of their own. An empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx

#: Fixed by the contract: what counts as a word, the repeating weights and the most a source is repeated.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
ROUNDS = 16
_CHUNK = 4096


def permuted(x, n, seed: int, *salts) -> F.Column:
    """x of 0..n-1 under a pseudorandom permutation of 0..n-1 that seed and salts choose."""

    def one(value, r):
        pivot = F.pmod(F.xxhash64(F.lit(seed), *salts, r), n)
        other = F.pmod(pivot - value, n)
        return F.when(F.xxhash64(F.lit(seed + 1), *salts, r, F.greatest(value, other)) % 2 == 0, value).otherwise(other)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x.cast("long"), one)


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """doc_id, source, size in words and a hash that orders the documents."""
    n = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n.alias("size"), F.xxhash64(doc_id, text).alias("place"))


def targets(sizes: DataFrame) -> DataFrame:
    """Per source: sid (its number), source_size, weight and target in words."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("sid") % len(WEIGHTS) + 1).cast("int")))
    # sources reach their cap in order of cap / weight: the level at which the others share what is left
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * MOST
    per = per.withColumns({"_total": F.sum("source_size").over(whole), "_weights": F.sum("weight").over(whole)})
    left = F.col("_total") - F.coalesce(F.sum(cap).over(before), F.lit(0))
    share = F.try_divide(left.cast("double"), (F.col("_weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("double"))
    per = per.withColumn("_level", share).withColumn("_capped", cap <= F.col("_level") * F.col("weight"))
    level = F.min(F.when(~F.col("_capped"), F.struct(F.col("source_size") / F.col("weight"), "sid", "_level"))).over(whole)["_level"]
    return per.withColumn("target", F.when(F.col("_capped"), cap.cast("double")).otherwise(F.least(cap.cast("double"), level * F.col("weight")))).select("source", "sid", "source_size", "weight", "target")


def streams(sizes: DataFrame, goals: DataFrame, rows: int, block: int) -> DataFrame:
    """sizes with the columns of goals, blocks and slots of its source, and `start`: the words before it in its source's stream."""
    buckets = max(256, rows // 50_000)
    own = sizes.join(goals, sizes["source"].eqNullSafe(goals["source"])).drop(goals["source"]).withColumn("bucket", F.pmod("place", F.lit(buckets)))
    sums = own.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket"))
    sums = sums.withColumn("before", F.sum("in_bucket").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("in_bucket")).drop("in_bucket")
    inside = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return own.withColumn("inside", inside).join(sums, ["sid", "bucket"]).withColumn("start", F.col("before") + F.col("inside")).drop("before", "inside", "bucket", "place")


def plan_slots(goals: DataFrame, block: int) -> DataFrame:
    """goals with blocks, slots and first (the number of slots of the sources before)."""
    blocks = F.ceil(F.col("source_size") / block).cast("long")
    slots = F.coalesce(F.round(F.try_divide(F.col("target") * blocks, F.col("source_size"))).cast("long"), F.lit(0))
    out = goals.withColumns({"blocks": blocks, "slots": F.least(slots, blocks * MOST)})
    return out.withColumn("first", F.sum("slots").over(Window.orderBy("sid")) - F.col("slots"))


def mix(docs: DataFrame, block: int = 128, slots_per_shard: int = 8192, seed: int = 11, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The output's plan and the documents.

    Plan: shard, slot (in the shard), sid, block, doc start (in its stream), from_word and words:
    the words of a document that the slot takes. Documents: doc_id, size, sid, source_size, target, start.
    """
    sizes = tx.settled(sized(docs, doc_id, text, source))
    goals = tx.settled(plan_slots(targets(sizes), block))
    rows, total = sizes.count(), goals.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    placed = tx.settled(streams(sizes, goals, rows, block))
    chunks = goals.where("slots > 0").select("sid", "blocks", "slots", "first", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("slots") - 1).cast("long"), F.lit(_CHUNK).cast("long"))).alias("chunk"))
    chunks = chunks.repartition(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // 1_000_000), "sid", "chunk")
    slots = chunks.select("sid", "blocks", "first", F.explode(F.sequence("chunk", F.least(F.col("chunk") + _CHUNK, F.col("slots")) - 1)).alias("i"))
    number = permuted(F.col("i") % F.col("blocks"), F.col("blocks"), seed, F.col("sid"), F.floor(F.col("i") / F.col("blocks")))
    output = permuted(F.col("first") + F.col("i"), F.lit(max(1, total)), seed + 2)
    slots = slots.select("sid", number.alias("block"), output.alias("output"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    pieces = placed.where("size > 0").select("sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    low = F.greatest(F.col("start"), F.col("block") * block)
    pieces = pieces.select("sid", "start", "block", (low - F.col("start")).alias("from_word"), (F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - low).alias("words"))
    joined = pieces.join(slots.hint("merge"), ["sid", "block"])  # else the slots are taken for as few as the chunks, and broadcast
    plan = joined.select(F.floor(F.col("output") / slots_per_shard).alias("shard"), (F.col("output") % slots_per_shard).alias("slot"), "sid", "block", "start", "from_word", "words")
    return plan, placed


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and the words that the mix takes, for every row of docs."""
    plan, placed = mix(docs, **options)
    used = plan.groupBy("sid", "start").agg(F.sum("words").alias("taken"))
    full = placed.where("size > 0").join(used, ["sid", "start"], "left")
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    out = full.select(*none.columns).unionByName(none)
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken(spark.read.parquet(f"{sf_dir}/documents.parquet"))
