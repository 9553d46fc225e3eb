"""Left joins of many rows with a dimension of any size, such that rows without a match are not shuffled.

Three ways, by the dimension's counted rows and stated sizes:

1. The dimension fits a broadcast: rows stay where they are.
2. It does not, but a Bloom filter of its keys does: the filter is bitmap rows (a key's bits all lie in the one row
   that its hash names), made by bitmap aggregates with map-side combining and broadcast. Distinct keys that may hit
   meet the dimension by a shuffle; what they find is broadcast if it fits. Else rows that may hit travel: those of
   keys with over one in HOT_SHARE of the rows meet the few rows of these keys by a broadcast, others by a shuffle.
3. The filter does not fit either: all rows are shuffled.

All three give the same rows; a false positive of the filter costs a row's way to the join and no more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Bits of one bitmap row, as the bitmap aggregates have them.
BITS = 1 << 15
RATE = 0.01
BROADCAST_BYTES = 64 << 20
#: What a dimension's row is taken to hold in a broadcast.
ROW_BYTES = 256
HOT_SHARE = 1000


@dataclass(frozen=True)
class BloomFilter:
    """words has a row (bucket, 512 words of 64 bits) for each bitmap with a bit set."""

    words: DataFrame
    buckets: int
    hashes: int

    def may_hold(self, df: DataFrame, key: str, out: str = "_may") -> DataFrame:
        """Add whether the key may be in the set; false for null."""
        side = F.broadcast(self.words.select(F.col("bucket").alias("_bucket"), F.col("words").alias("_words")))
        hit = F.forall(_positions(F.col(key), self.hashes), lambda p: F.getbit(F.get(F.col("_words"), F.shiftright(p, 6)), 8 * (7 - F.shiftright(p, 3).bitwiseAND(7)) + p.bitwiseAND(7)) == 1)
        joined = df.join(side, _bucket(F.col(key), self.buckets) == F.col("_bucket"), "left")
        return joined.withColumn(out, F.coalesce(F.col("_words").isNotNull() & F.col(key).isNotNull() & hit, F.lit(False))).drop("_bucket", "_words")


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _positions(key: Column, hashes: int) -> Column:
    """Bits of a key within its bitmap: steps of an odd stride from a start, both from a second hash."""
    second = F.xxhash64(key, F.lit("bits"))
    start, stride = second.bitwiseAND(BITS - 1), F.shiftrightunsigned(second, 15).bitwiseAND(BITS - 1).bitwiseOR(1)
    return F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: (start + i * stride).bitwiseAND(BITS - 1).cast("int"))


def filter_size(keys: int, rate: float) -> tuple[int, int]:
    """(bitmaps, hashes) for so many keys at a false-positive rate."""
    if not 0 < rate < 1:
        raise ValueError("rate must be between 0 and 1")
    bits = max(keys, 1) * -math.log(rate) / math.log(2) ** 2
    return math.ceil(bits / BITS), max(1, round(-math.log2(rate)))


def bloom_filter(keys: DataFrame, key: str, count: int, rate: float = RATE) -> BloomFilter:
    """The filter of a column's values other than null, sized for count of them."""
    buckets, hashes = filter_size(count, rate)
    rows = keys.where(F.col(key).isNotNull()).select(_bucket(F.col(key), buckets).alias("bucket"), F.explode(_positions(F.col(key), hashes)).alias("position"))
    bitmaps = rows.groupBy("bucket").agg(F.bitmap_construct_agg(F.col("position").cast("long")).alias("bitmap"))
    word = lambda i: F.conv(F.hex(F.substring(F.col("bitmap"), 8 * i + 1, F.lit(8))), 16, -10).cast("long")
    words = bitmaps.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(BITS // 64 - 1)), word).alias("words"))
    return BloomFilter(stored(words, "filter"), buckets, hashes)


def attach(df: DataFrame, key: Column, side: DataFrame, side_key: str, rate: float = RATE, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df left joined with side where key equals side_key, which leaves; side's other columns must not be df's."""
    held = stored(side.where(F.col(side_key).isNotNull()).withColumnRenamed(side_key, "_key"), "dimension")
    n = held.count()
    want = df.withColumn("_want", key)
    on = F.col("_want") == F.col("_key")
    if n * ROW_BYTES <= limit:
        return want.join(F.broadcast(held), on, "left").drop("_want", "_key")
    if filter_size(n, rate)[0] * BITS // 8 > limit:
        return want.join(held, on, "left").drop("_want", "_key")
    bloom = bloom_filter(held, "_key", n, rate)
    seen = bloom.may_hold(want.select("_want").where(F.col("_want").isNotNull()), "_want").where("_may").groupBy("_want").agg(F.count(F.lit(1)).alias("_n"))
    found = stored(seen.join(held, on).drop("_want"), "found")
    hits, rows = found.agg(F.count(F.lit(1)), F.coalesce(F.sum("_n"), F.lit(0))).first()
    if hits * ROW_BYTES <= limit:
        return want.join(F.broadcast(found.drop("_n")), on, "left").drop("_want", "_key")
    return _travel(bloom.may_hold(want, "_want"), found, rows)


def _travel(marked: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """Rows that may hit meet what was found (rows of them do), hot keys by a broadcast; the others get nulls."""
    on = F.col("_want") == F.col("_key")
    hot = F.col("_n") * HOT_SHARE > rows
    few = F.broadcast(found.where(hot))
    apart = marked.where("_may").join(few.select(F.col("_key").alias("_hot")).distinct(), F.col("_want") == F.col("_hot"), "left")
    at_hot = apart.where("_hot is not null").drop("_hot").join(few, on)
    at_rest = apart.where("_hot is null").drop("_hot").join(found.where(~hot), on, "left")
    nothing = marked.where("not _may").withColumns({f.name: F.lit(None).cast(f.dataType) for f in found.schema})
    return at_hot.unionByName(at_rest).unionByName(nothing).drop("_want", "_may", "_key", "_n")
