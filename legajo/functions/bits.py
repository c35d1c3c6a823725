"""A set of keys as one value of fixed size, tested in the row: false hits are possible, misses are not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits of a set: a million bits, 128 KB, whatever the number of keys.
WORDS = 1 << 14


#: The most words of a set that grows with its keys: 8 million bits, 1 MB.
MOST_WORDS = 1 << 17
#: Bits for each key that ``words_for`` leaves.
BITS_PER_KEY = 16


def words_for(keys: int) -> int:
    """Words of a set of so many keys, a power of two: few false hits, and a size that is bounded however many there are."""
    wanted = 1 << max(keys * BITS_PER_KEY // 64 - 1, 0).bit_length()
    return min(max(wanted, WORDS), MOST_WORDS)


def _slots(key: Column, words: int) -> tuple[Column, Column]:
    """The two bits of a key, of hashes that do not depend on each other."""
    size = F.lit(words * 64)
    return F.pmod(F.xxhash64(key), size), F.pmod(F.xxhash64(key, F.lit(1)), size)


def bit_set(keys: DataFrame, column: str, words: int = WORDS) -> Column:
    """The values of ``column`` as a scalar subquery, an array of ``words`` longs. Bits are joined before and after
    the shuffle, so what is gathered never depends on the number of keys. To be a column before it is used in a
    higher-order function."""
    slot = keys.select(F.explode(F.array(*_slots(F.col(column), words))).alias("slot"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("slot", F.lit(64)).cast("int"))
    found = slot.groupBy(F.floor(F.col("slot") / 64).alias("id")).agg(F.bit_or(bit).alias("bits"))
    every = keys.sparkSession.range(words).join(found, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"])).scalar()


def may_hold(bits: Column, key: Column, words: int = WORDS) -> Column:
    """Whether ``key`` may be in the set; surely not if false."""

    def is_set(slot: Column) -> Column:
        word = F.get(bits, F.floor(slot / 64).cast("int"))
        return F.call_function("shiftrightunsigned", word, F.pmod(slot, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1

    first, second = _slots(key, words)
    return is_set(first) & is_set(second)
