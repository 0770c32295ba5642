"""Ranks, running totals and quantiles by ranges of an order: no task sees all rows of it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges, a power of two, and sampled rows for each of them.
RANGES, EACH = 256, 32


def before(rows: DataFrame, bucket: Column, order: tuple[str, ...], by: tuple[str, ...] = (), **sums: Column) -> DataFrame:
    """``rows`` with, for each of ``sums``, its total over the rows of the same ``by`` that come before in ``order``.

    ``bucket`` must grow with the order.  Rows are ordered inside their bucket
    alone, and one task sees only the buckets' totals.
    """
    dealt = rows.withColumn("_bucket", bucket)
    totals = dealt.groupBy(*by, "_bucket").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items()))
    through = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_bucket").alias("_start"), *(F.coalesce(F.sum(f"_{n}").over(through), F.lit(0)).alias(f"_{n}") for n in sums))
    inside = Window.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()))
    found = found.join(starts, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(d)) for c, d in [("_bucket", "_start"), *((c, f"_{c}") for c in by)])))
    return found.select(*rows.columns, *((F.col(n) + F.col(f"_{n}")).alias(n) for n in sums))


def in_ranges(rows: DataFrame, order: tuple[str, ...], ranges: int = RANGES) -> DataFrame:
    """``rows`` with ``_range``, which grows with ``order`` and splits the rows nearly evenly.

    The splitters are every EACHth of the rows of least hash, a sample of at most
    ``ranges`` times EACH; where they lie changes the balance and no result.  Equal
    keys share a range, so ``order`` should end in a column that tells rows apart.
    """
    key = F.struct(*order)
    least = rows.select(key.alias("_key")).orderBy(F.xxhash64("_key"), "_key").limit(ranges * EACH)
    sample = least.agg(F.sort_array(F.collect_list("_key")).alias("_sample"))
    cuts = sample.select(F.filter("_sample", lambda _, i: i % EACH == EACH - 1).alias("_cuts"))
    halves = F.array(*(F.lit(ranges >> k) for k in range(ranges.bit_length())))

    def step(found: Column, width: Column) -> Column:
        return F.when(F.get(F.col("_cuts"), found + width - 1) <= key, found + width).otherwise(found)

    return rows.join(F.broadcast(cuts)).withColumn("_range", F.aggregate(halves, F.lit(0), step)).drop("_cuts")


def ranked(rows: DataFrame, order: tuple[str, ...], name: str = "place") -> DataFrame:
    """``rows`` with their place in ``order``, from 1."""
    found = before(in_ranges(rows, order), F.col("_range"), order, **{name: F.lit(1).cast("long")})
    return found.select(*rows.columns, (F.col(name) + 1).alias(name))


def value_statistics(values: DataFrame, by: str, value: str) -> DataFrame:
    """n_values, std, min, max, mean and the exact median of each group; nulls don't count.

    Equal values are counted first, with partial counts; the counts are ordered
    by ranges of (group, value).  So a group that is nearly all of the input is
    spread over tasks, and none holds it.
    """
    v, n = F.col(value), F.col("_n")
    counts = values.where(v.isNotNull()).groupBy(by, value).agg(F.count("*").alias("_n"))
    groups = counts.groupBy(by).agg(F.sum(n).alias("n_values"), (F.sum(v * n) / F.sum(n)).alias("mean"))
    run = before(in_ranges(counts, (by, value)), F.col("_range"), (value,), (by,), _run=n).join(groups, by)
    holds = lambda at: (F.col("_run") <= at) & (F.col("_run") + n > at)
    low, high = F.floor((F.col("n_values") - 1) / 2), F.floor(F.col("n_values") / 2)
    out = run.groupBy(by, "n_values", "mean").agg(
        F.sqrt(F.sum(n * F.pow(v - F.col("mean"), 2)) / F.sum(n)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.max(F.when(holds(low), v)).alias("_low"), F.max(F.when(holds(high), v)).alias("_high")
    )
    middle = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise((F.col("_low") + F.col("_high")) / 2)
    return out.select(by, "n_values", "std", "min", "max", "mean", middle.alias("median"))
