"""A blocked Bloom filter out of DataFrame functions.

A key belongs to one block of 64 bits and sets four of them. The filter is a single
literal array of all blocks. Blocks are counted out from the keys, four keys to a block,
up to `MOST_BLOCKS`; at four keys one stranger in 200 passes. With more than
16 keys to each of the most blocks the filter would tell little: then there is none, all keys
pass, and the exact join behind it does the whole work. No key is ever lost.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Half a megabyte of bits.
MOST_BLOCKS = 1 << 16


class Filter(NamedTuple):
    """`words` is None where all keys pass."""

    words: Column | None
    blocks: int

    def may_contain(self, key: Column) -> Column:
        """False only for keys that the filter doesn't have."""
        if self.words is None:
            return F.lit(True)
        mask = _mask(key)
        return F.get(self.words, _block(key, self.blocks)).bitwiseAND(mask) == mask


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _mask(key: Column) -> Column:
    """Four bits by a second hash, six of its bits for each."""
    second = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftrightunsigned(second, 6 * k), F.lit(64)).cast("int")) for k in range(4)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2]).bitwiseOR(bits[3])


def number_array(numbers: list[int]) -> Column:
    """A literal array of numbers, folded once when a plan is optimised."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>") if numbers else F.array().cast("array<bigint>")


def build(keys: DataFrame, key: str, most: int = MOST_BLOCKS) -> Filter:
    """The filter of the values of a column of a table that is cheap to read twice.

    What comes to the driver is at most one number for each block, whatever the keys are.
    """
    known = keys.where(F.col(key).isNotNull())
    count = known.count()
    if count > 16 * most:
        return Filter(None, 0)
    blocks = min(most, 1 << max(0, (count // 4)).bit_length())
    some = known.groupBy(_block(F.col(key), blocks).alias("b")).agg(F.bit_or(_mask(F.col(key))).alias("m"))
    words = [0] * blocks
    for row in some.collect():
        words[row["b"]] = row["m"]
    return Filter(number_array(words), blocks)
