"""From availability masks to the combinations of attributes that they contain, by equi-joins.

A combination's rows are those whose mask is one of its supersets. Masks go down the lattice a few attributes at
a time: what a mask holds of a group of ``BITS`` attributes is joined, by its value, to the parts of combinations
that it contains (a table of at most 3**BITS rows), parts that begin no wanted combination go, and what has
become equal is added up. Nothing is compared with all combinations, and the cost is that of the distinct masks.

Units are counted by their sets of masks: units with the same set (told by two 64-bit sums of hashes and its size)
reach the same combinations, so a set goes down once, whatever number of units has it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Attributes that are decided together.
BITS = 8


def _down(masks: DataFrame, combos: DataFrame, n_attrs: int, keys: Sequence[str], merge: Column | None) -> DataFrame:
    """Rows (keys, mask) to rows (keys, combo_mask) of the combinations they contain, each once; merge adds up ``n``."""
    spark = masks.sparkSession
    wanted = combos.select(F.col("combo_mask").alias("__done")).distinct()
    now = masks.select(*keys, *(["n"] if merge is not None else []), F.col("mask").alias("__rest"), F.lit(0).cast("long").alias("__done"))
    for shift in range(0, max(n_attrs, 1), BITS):
        bits = min(BITS, n_attrs - shift)
        part = F.shiftrightunsigned("__done", shift).bitwiseAND(F.lit((1 << bits) - 1))
        parts = [r[0] for r in wanted.select(part.cast("long")).distinct().collect()]  # at most 2**BITS numbers
        pairs = [(v, p) for v in range(1 << bits) for p in parts if v & p == p]
        table = spark.createDataFrame(pairs, "__value long, __part long")
        value = F.shiftrightunsigned("__rest", shift).bitwiseAND(F.lit((1 << bits) - 1)).cast("long")
        now = now.withColumn("__value", value).join(table, "__value")
        now = now.withColumn("__done", F.col("__done").bitwiseOR(F.shiftleft("__part", shift))).drop("__value", "__part")
        # decided attributes no longer tell masks apart
        now = now.withColumn("__rest", F.shiftleft(F.shiftrightunsigned("__rest", shift + bits), shift + bits) if shift + bits < 64 else F.lit(0).cast("long"))
        if n_attrs > BITS:
            begun = wanted.select(F.col("__done").bitwiseAND(F.lit((1 << (shift + bits)) - 1)).alias("__done")).distinct()
            now = now.join(begun, "__done", "left_semi")
        now = now.groupBy(*keys, "__done", "__rest").agg(merge.alias("n")) if merge is not None else now.distinct()
    return now.drop("__rest").withColumnRenamed("__done", "combo_mask")


def superset_sums(counts: DataFrame, combos: DataFrame, n_attrs: int, keys: Sequence[str] = ()) -> DataFrame:
    """Of (keys, mask, n): for each key and combination that some mask contains, the sum of n: (keys, combo_mask, n)."""
    return _down(counts, combos, n_attrs, keys, F.sum("n"))


def superset_units(seen: DataFrame, combos: DataFrame, n_attrs: int, unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Of (keys, unit, mask), the unit not null: for each key and combination, the units of which a mask contains it:
    (keys, combo_mask, n)."""
    seen = seen.select(*keys, unit, "mask").distinct()
    marks = [F.bit_xor(F.xxhash64("mask", F.lit(s))).alias(f"__h{s}") for s in (1, 2)]
    sets = seen.groupBy(*keys, unit).agg(*marks, F.count(F.lit(1)).alias("__k"))
    of_set = [*keys, "__h1", "__h2", "__k"]
    kinds = sets.groupBy(*of_set).agg(F.count(F.lit(1)).alias("__units"), F.min(unit).alias(unit))
    renamed = seen.withColumnsRenamed({c: f"__of_{c}" for c in (*keys, unit)})  # keys may be null
    masks = kinds.join(renamed, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in (*keys, unit)]).select(*of_set, "__units", "mask")
    return _down(masks, combos, n_attrs, [*of_set, "__units"], None).groupBy(*keys, "combo_mask").agg(F.sum("__units").alias("n"))
