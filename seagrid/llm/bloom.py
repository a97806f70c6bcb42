"""A blocked Bloom filter as a table, in native expressions: one 256-bit block and one bit in each of its eight words for a key.

A lookup reads one block, by an equi-join on its number; the table is broadcast while its size allows. Defined cases:
null keys are none; no keys let nothing through; repeated rows stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY = 16
BROADCAST_BYTES = 8 << 20
_WORDS = 8


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n_blocks))


def _masks(key: Column) -> list[Column]:
    """One bit in each word of the block, from eight 5-bit fields of a second hash."""
    h = F.xxhash64(F.lit("bits"), key)
    return [F.call_function("shiftleft", F.lit(1), F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int")) for i in range(_WORDS)]


def bloom_filter(keys: DataFrame, n_blocks: int) -> DataFrame:
    """Rows (block, w0..w7) of the blocks that hold a key."""
    rows = keys.select(_block(F.col("key"), n_blocks).alias("block"), *[m.alias(f"w{i}") for i, m in enumerate(_masks(F.col("key")))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(_WORDS)])


def possible_hits(probes: DataFrame, keys: DataFrame, bits_per_key: int = BITS_PER_KEY, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The probes (with a column `key`) whose block has all their bits set."""
    return _hits(probes, keys, _n_blocks(keys, bits_per_key), broadcast_bytes)


def _n_blocks(keys: DataFrame, bits_per_key: int) -> int:
    return max(1, -(-keys.count() * bits_per_key // (32 * _WORDS)))


def _bytes(n_blocks: int) -> int:
    return n_blocks * 8 * (_WORDS + 1)


def _hits(probes: DataFrame, keys: DataFrame, n_blocks: int, broadcast_bytes: int) -> DataFrame:
    blocks = bloom_filter(keys, n_blocks)
    if _bytes(n_blocks) <= broadcast_bytes:
        blocks = F.broadcast(blocks)
    found = probes.withColumn("block", _block(F.col("key"), n_blocks)).join(blocks, "block")
    for i, mask in enumerate(_masks(F.col("key"))):
        found = found.where(F.col(f"w{i}").bitwiseAND(mask) == mask)
    return found.drop("block", *[f"w{i}" for i in range(_WORDS)])


def among(rows: DataFrame, keys: DataFrame, exact: bool = True) -> DataFrame:
    """The rows whose `key` is in keys, a stored table with that one column.

    A filter that is small enough to broadcast leaves few rows to the shuffle of the exact semi-join; beyond that size the
    semi-join stands alone. Without `exact` rows with other keys may remain, for a caller that joins them anyway.
    """
    n_blocks = _n_blocks(keys, BITS_PER_KEY)
    near = _hits(rows, keys, n_blocks, BROADCAST_BYTES) if _bytes(n_blocks) <= BROADCAST_BYTES else rows
    return near.join(keys, "key", "left_semi") if exact else near
