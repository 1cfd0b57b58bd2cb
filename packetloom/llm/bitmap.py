"""A bitmap of fixed size as a first sieve before a join on hashes.

Its size is a parameter, so it may be broadcast whatever the data's size; a
fuller bitmap lets more rows through to the join that follows, and none is
lost.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2**27 bits are 16 MB.
MOST_BITS = 1 << 27


def bits_for(n_values: int, each: int = 32, most: int = MOST_BITS) -> int:
    """A power of two: about ``each`` bits a value, within bounds."""
    return min(most, 1 << max(16, (n_values * each - 1).bit_length()))


def build(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """The bitmap of the lowest bits of a column of hashes; at most bits / 64 rows reach the driver."""
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    words = values.select(F.shiftright(slot, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(bits >> 6, dtype=np.uint64)
    out[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).view(np.uint64)
    return out


def contains(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned 64-bit) may be among the values."""
    slots = hashes & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(slots >> np.uint64(6)).view(np.int64)] >> (slots & np.uint64(63)) & np.uint64(1)).view(np.int64).astype(bool)
