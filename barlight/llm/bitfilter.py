"""A filter of bounded size over hashed keys, made and applied with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter; 1 MB, whatever the number of keys.
BITS = 1 << 23


def bit_filter(keys: DataFrame, column: str) -> DataFrame:
    """One row with the filter's words as an array<bigint>, for may_contain."""
    at = F.pmod(F.xxhash64(column), F.lit(BITS))
    words = keys.select(F.floor(at / 64).alias("word"), F.shiftleft(F.lit(1).cast("long"), 0).alias("one"), (at % 64).cast("int").alias("bit"))
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(one, bit))").alias("bits"))
    whole = keys.sparkSession.range(BITS // 64).withColumnRenamed("id", "word").join(words, "word", "left")
    return whole.agg(F.expr("transform(array_sort(collect_list(struct(word, coalesce(bits, 0L) as bits))), x -> x.bits)").alias("words"))


def may_contain(words: Column, key: Column) -> Column:
    """False only if key is not among the filter's keys."""
    at = F.pmod(F.xxhash64(key), F.lit(BITS))
    bit = F.call_function("shiftrightunsigned", F.element_at(words, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int"))
    return bit.bitwiseAND(F.lit(1).cast("long")) == 1
