"""Jump consistent hashing (Lamping and Veach, 2014) as column expressions, and gapless slots inside each shard."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the published algorithm: multiplier of its generator, and 2^31.
MULTIPLIER = 2862933555777941757
SCALE = float(1 << 31)
FIRST_STEPS = 64
#: Slot ranges over all shards; a power of two. At 3e10 rows one range has under half a million rows.
SLOT_RANGES = 1 << 16


def key_hash(key: Column) -> tuple[Column, Column]:
    """High and low 32 bits of the 64-bit hash of a key's text; null counts as the empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    half = lambda start: F.conv(F.substring(digest, start, 8), 16, 10).cast("long")
    return half(1), half(9)


def _step(state: Column, n: int) -> Column:
    """One draw: the next 64-bit number of the generator, in 32-bit halves that cannot overflow, and the next jump."""
    high, low, target = state["high"], state["low"], state["next"]
    mask, c_high, c_low = 0xFFFFFFFF, MULTIPLIER >> 32, MULTIPLIER & 0xFFFFFFFF
    c_mid, c_end = c_low >> 16, c_low & 0xFFFF
    middle = low * c_mid
    bottom = low * c_end + F.shiftleft(middle.bitwiseAND(0xFFFF), 16) + 1
    top = (
        F.shiftright(bottom, 32) + F.shiftright(middle, 16) + (low * c_high).bitwiseAND(mask)
        + high * c_end + F.shiftleft((high * c_mid).bitwiseAND(0xFFFF), 16)
    ).bitwiseAND(mask)
    jump = F.floor((target + 1).cast("double") * (F.lit(SCALE) / (F.shiftright(top, 1) + 1).cast("double"))).cast("long")
    moved = F.struct(
        top.alias("high"), bottom.bitwiseAND(mask).alias("low"), target.alias("shard"), jump.alias("next"))
    return F.when(target < n, moved).otherwise(state)


def jump_shard(high: Column, low: Column, n: int) -> Column:
    """Shard 0 to n-1 of a 64-bit key. With n+1 shards a key stays or moves to shard n, never elsewhere.

    The number of jumps is about ln n; keys not at their end after FIRST_STEPS go on for up to n more, so that
    the result is exact for every n.
    """
    if n < 1:
        raise ValueError("shards are needed")
    zero = F.lit(0).cast("long")
    start = F.struct(high.alias("high"), low.alias("low"), zero.alias("shard"), zero.alias("next"))
    steps = F.array(*[F.lit(i) for i in range(min(n, FIRST_STEPS))])
    state = F.aggregate(steps, start, lambda s, _: _step(s, n))
    if n > FIRST_STEPS:
        rest = F.when(state["next"] < n, F.sequence(F.lit(1), F.lit(n))).otherwise(F.array().cast("array<int>"))
        state = F.aggregate(rest, state, lambda s, _: _step(s, n))
    return state["shard"].cast("int")


def assign_shards(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size, text_crc32, law, shard, slot and grown_shard.

    `shard` depends on the key and the number of shards alone; `grown_shard` is the shard with one more. `slot` counts the
    rows of a shard from 0 without gaps, in the order of the key's hash: each shard is cut into ranges of the hash, which are
    counted on the key column alone, so that no task numbers a whole shard. A null key counts as the empty text,
    a null text has size 1 and the checksum of the empty text; repeated rows get slots of their own; an empty
    table gives no rows. Further columns of `docs` are not read.
    """
    ranges = max(1, SLOT_RANGES // (1 << (n_shards - 1).bit_length()))
    high, low = key_hash(F.col(key))
    hashed = docs.select(
        F.col(key).alias("doc_id"), high.alias("high"), low.alias("low"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = hashed.withColumns({
        "shard": jump_shard(F.col("high"), F.col("low"), n_shards),
        "slot_range": F.floor(F.col("high") * ranges / float(1 << 32)).cast("int"),
    })
    counted = placed.groupBy("shard", "slot_range").count()
    before = Window.partitionBy("shard").orderBy("slot_range").rowsBetween(Window.unboundedPreceding, -1)
    # At most SLOT_RANGES rows (or one per shard, if there are more shards).
    offsets = counted.select("shard", "slot_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "slot_range").orderBy("high", "low", "doc_id", "size", "text_crc32")
    numbered = placed.withColumn("number", F.row_number().over(inside).cast("long") - 1)
    return numbered.join(F.broadcast(offsets), ["shard", "slot_range"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("offset") + F.col("number")).alias("slot"),
        jump_shard(F.col("high"), F.col("low"), n_shards + 1).alias("grown_shard"),
    )
