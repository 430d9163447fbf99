"""Joins that stay balanced when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def shuffled(df: DataFrame) -> DataFrame:
    """*df* as a side of a join that grows with the input: never sent to the driver and broadcast.

    Spark guesses the size of a side from the files it starts from, not from what was exploded since.
    """
    return df.hint("merge")


def salted_join(
    big: DataFrame, unique: DataFrame, on: list[str], *, spread_by: list[str],
    how: str = "inner", salts: int = SALTS,
) -> DataFrame:
    """Join a possibly skewed *big* to *unique* (at most one row per key).

    Rows of one key are spread over *salts* partitions by *spread_by*; the
    unique side is repeated that often, so it must have narrow rows.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = unique.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(shuffled(right), [*on, "_salt"], how).drop("_salt")


def split_join(big: DataFrame, unique: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join a possibly skewed *big* to a *unique* side whose rows are many or wide: each row of both is shuffled once.

    A partition much larger than the others is split by Spark while it runs (its skew join), which reads the other
    side's partition again but writes nothing twice.  That takes a shuffle made for this join right below it; the
    added key follows from the others, so a side that lies by *on* already is shuffled as well.
    """
    lies = F.pmod(F.xxhash64(*on), F.lit(SALTS)).cast("int")
    return big.withColumn("_lies", lies).join(shuffled(unique.withColumn("_lies", lies)), [*on, "_lies"], how).drop("_lies")


#: Bits of a filter, 64 in a word; tasks put :data:`_WORDS` words at a time in order.  8 MB whatever the number of keys.
FILTER_BITS, _WORDS = 1 << 26, 1 << 10


def key_filter(keys: DataFrame, key: str) -> Column:
    """A filter of *keys* for :func:`may_hold`, made by tasks and read by all of them.

    Rows without a match can be left out before they are shuffled.  The more keys there are, the more of
    the others pass as well; the join decides.
    """
    bit = _bit(F.col(key))
    words = keys.where(F.col(key).isNotNull()).select(
        F.shiftright(bit, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.cast("int")).alias("bits"))
    none = keys.sparkSession.range(FILTER_BITS // 64).select(F.col("id").alias("word"), F.lit(0).cast("bigint").alias("bits"))
    rows = words.unionByName(none).groupBy("word").agg(F.bit_or("bits").alias("bits")).groupBy(
        F.shiftright("word", _WORDS.bit_length() - 1).alias("row")).agg(_in_order("word", "bits").alias("bits"))
    return rows.agg(F.flatten(_in_order("row", "bits")).alias("words")).scalar()


def _in_order(by: str, value: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(by, value))), lambda s: s[value])


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS).cast("bigint"))


def may_hold(filter_: Column, key: Column) -> Column:
    """Whether *key* may be among the keys of a :func:`key_filter`; true for each that is."""
    bit = _bit(key)
    word = F.get(filter_, F.shiftright(bit, 6).cast("int"))
    # the bits above the lowest six do not count in a shift
    return F.call_function("shiftright", word, bit.cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
