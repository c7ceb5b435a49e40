"""Duplicate rows by fingerprint: rows are counted on a narrow key, and compared in full
only where a key repeats.

A fingerprint is two 64-bit hashes of all columns (nulls marked, -0.0 as 0.0, so equal
rows always have equal ones). Only fingerprints cross the network; those that repeat set a
bit each in a map of ``MAP_BITS`` bits, which is broadcast: of one size however many repeat,
so rows without a copy are never shuffled to find that out. The rows whose bit is set are
compared in whole: an accidental collision, of fingerprints or of bits, costs a comparison,
never a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["_fp1", "_fp2"]
#: 16 MB, in blocks of 4 KB. With n repeated fingerprints some n / MAP_BITS of the other rows are compared for nothing.
MAP_BITS = 1 << 27
BLOCK_BITS = 1 << 15


def fingerprint(df: DataFrame, bits: int = 128) -> list[Column]:
    """The two halves; fewer than 128 ``bits`` shorten them (to force collisions in tests)."""
    parts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        parts += [c + F.lit(0.0) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c, c.isNull()]
    halves = [F.xxhash64(F.lit(salt), *parts) for salt in (1, 2)]
    if bits < 128:
        halves = [F.pmod(halves[0], F.lit(1 << min(bits, 62))), F.lit(0).cast("long")]
    return [h.alias(k) for h, k in zip(halves, KEYS)]


def marked(df: DataFrame, bits: int = 128) -> DataFrame:
    return df.select("*", *fingerprint(df, bits))


def repeated(df: DataFrame, bits: int = 128) -> DataFrame:
    """(_fp1, _fp2): the fingerprints of more than one row."""
    return (df.select(*fingerprint(df, bits)).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
            .where("n > 1").select(*KEYS))


def _slot(size: int) -> tuple[Column, Column]:
    """Block and place in it of a fingerprint's bit. ``size`` is a power of two: bit operations give no nulls, so
    the optimizer adds no null checks that would compute the whole fingerprint a second time."""
    slot = F.col("_fp1").bitwiseAND(F.lit(size - 1))
    return F.shiftright(slot, BLOCK_BITS.bit_length() - 1), slot.bitwiseAND(F.lit(BLOCK_BITS - 1))


def repeated_map(df: DataFrame, bits: int = 128, size: int = MAP_BITS) -> DataFrame:
    """(_block, _bits): the bit of each repeated fingerprint."""
    block, place = _slot(size)
    return repeated(df, bits).groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(place).alias("_bits"))


def _by_map(df: DataFrame, how: str, bits: int, size: int) -> DataFrame:
    """The rows whose bit is set (``left_semi``) or not set (``left_anti``)."""
    block, place = _slot(size)
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7)).cast("int")).bitwiseAND(1) == 1
    same = (F.col("_block") == block) & is_set
    return marked(df, bits).join(F.broadcast(repeated_map(df, bits, size)), same, how).select(*[f"`{c}`" for c in df.columns])


def distinct_rows(df: DataFrame, bits: int = 128, size: int = MAP_BITS) -> DataFrame:
    """One of each row, as ``dropDuplicates`` gives, without shuffling rows that have no copy."""
    return _by_map(df, "left_anti", bits, size).unionByName(_by_map(df, "left_semi", bits, size).dropDuplicates())


def copies(df: DataFrame, bits: int = 128, flag: Column | None = None, size: int = MAP_BITS) -> tuple[Column, Column]:
    """Scalars: rows beyond the first of their kind, of all rows and of those for which ``flag`` holds
    (an expression on the columns, so that equal rows agree on it)."""
    rows = _by_map(df, "left_semi", bits, size)
    kinds = rows.groupBy(*df.columns).agg((F.count(F.lit(1)) - 1).alias("_beyond"))
    flagged = F.lit(True) if flag is None else flag
    found = kinds.agg(F.coalesce(F.sum("_beyond"), F.lit(0)).alias("n"),
                      F.coalesce(F.sum(F.when(flagged, F.col("_beyond"))), F.lit(0)).alias("n_flagged"))
    found = found.select(F.struct("n", "n_flagged")).scalar()
    return found["n"], found["n_flagged"]
