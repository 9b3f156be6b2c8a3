"""Sharding by jump consistent hashing (Lamping and Veach, 2014). JVM side only.

A key walks through the shard counts at which it would move; its shard is the last such count that is at most the wanted one.
The walk depends on the key alone, so one more shard takes rows only into itself and about one row in ``shards + 1`` moves.
There is no ring table and nothing is looked up: the expression is evaluated in the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.llm.columns import read_table

#: Groups that a shard's rows are numbered in, each on its own; their counts (shards * SLOT_GROUPS rows) are all that is broadcast.
SLOT_GROUPS = 256


def jump_hash(key: Column, shards: int) -> Column:
    """Shard of ``key`` in 0 to ``shards - 1``. Null keys count as one key like any other.

    The n-th draw of a key is a hash of key and n, in (0, 1]. Each step goes at least one count up, so ``shards`` steps are enough.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")

    def step(at: Column, n: Column) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, n), 11) + F.lit(1)).cast("double") * F.lit(2.0**-53)
        up = F.floor((at["next"] + F.lit(1)).cast("double") / draw)
        return F.when(
            at["next"] < F.lit(shards),
            F.struct(at["next"].alias("shard"), F.least(up, F.lit(1 << 40)).cast("bigint").alias("next")),
        ).otherwise(at)

    start = F.struct(F.lit(-1).cast("bigint").alias("shard"), F.lit(0).cast("bigint").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda at: at["shard"].cast("int"))


def shard(df: DataFrame, key: str, shards: int, salt: str | None = None) -> DataFrame:
    """``df`` with ``shard``, ``grown_shard`` (with one shard more) and ``slot``, the row's gapless place in its shard from 0.

    ``salt``: a further column that spreads rows of one key over the groups in which slots are numbered. Rows are shuffled
    once, by (shard, group); a group's offset comes from the counts of all groups, ``shards * SLOT_GROUPS`` numbers at most,
    which the driver adds up. Extra columns stay; an empty table gives an empty table; repeated rows each get a slot of their own.
    """
    by = [F.col(key)] + ([F.col(salt)] if salt else [])
    placed = df.withColumns(
        {
            "shard": jump_hash(F.col(key), shards),
            "grown_shard": jump_hash(F.col(key), shards + 1),
            "_group": F.pmod(F.xxhash64(*by), F.lit(SLOT_GROUPS)).cast("int"),
        }
    )
    # offsets of all groups are a list of fixed size, which goes into the plan as a literal
    counts = {(r["shard"], r["_group"]): r["n"] for r in placed.groupBy("shard", "_group").agg(F.count("*").alias("n")).collect()}
    offsets = []
    for k in range(shards):
        at = 0
        for g in range(SLOT_GROUPS):
            offsets.append(at)
            at += counts.get((k, g), 0)
    listed = F.split(F.lit(",".join(map(str, offsets))), ",").cast("array<bigint>")
    rank = F.row_number().over(Window.partitionBy("shard", "_group").orderBy(*by))
    first = F.get(listed, F.col("shard") * SLOT_GROUPS + F.col("_group"))
    return placed.withColumn("slot", first + rank - F.lit(1)).drop("_group")


def op8_jump_sharding(spark: SparkSession, sf_dir: str, shards: int = 40) -> DataFrame:
    """All ``documents`` in 40 shards, law ``key``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Null text: size 16 and the crc32 of no bytes, 0. Columns beyond doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text).cast("bigint") + F.lit(16)).alias("size"), F.crc32(text).alias("text_crc32")
    )
    return shard(rows, "doc_id", shards, salt="text_crc32").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
