"""Running aggregates and order statistics that no key, however hot, and no single task holds.

A key of more than HOT_ROWS rows is cut into blocks of time. Rows are ordered within their
block; what earlier blocks add up to is carried over from one row a block. Other keys are
ordered as a whole, and a log without hot keys is planned as if there were no blocks.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..scratch import Scratch

#: Rows of a key from which on it is worked on in blocks, and the seconds of a block.
HOT_ROWS, SECONDS = 4_000_000, 3600
#: Bytes of a counted side that a join is told to broadcast.
BROADCAST_BYTES = 8 << 20


def spread(rows: DataFrame, keys: list[str], counted: DataFrame | None = None, time: str = "occurred_at", most: int = HOT_ROWS, seconds: int = SECONDS) -> DataFrame:
    """``rows``, with a ``block`` of time for those of keys that have more than ``most`` rows
    (null for others), if there is such a key. ``counted`` is a narrower frame of the same
    rows. Of n rows at most n / ``most`` keys are hot; they are broadcast if they come to few bytes."""
    hot = (counted or rows).groupBy(*keys).count().where(F.col("count") > most).select(*keys, F.lit(True).alias("hot"))
    n = hot.count()
    if not n:
        return rows
    told = rows.join(F.broadcast(hot) if n * 64 * len(keys) <= BROADCAST_BYTES else hot, keys, "left")
    return told.withColumn("block", F.when(F.col("hot"), F.call_function("div", F.col(time), F.lit(seconds)))).drop("hot")


def running(
    rows: DataFrame, keys: list[str], order: tuple[str, ...], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, ors: dict[str, Column] | None = None
) -> DataFrame:
    """``rows`` with, by ``keys`` in ``order``: the sum of each of ``sums`` up to and with the
    row, and of the rows before it the last value that isn't null of each of ``lasts`` and the
    bitwise or of each of ``ors``. Hot keys are those with a ``block`` (see :func:`spread`)."""
    sums, lasts, ors = sums or {}, lasts or {}, ors or {}
    block = ["block"] if "block" in rows.columns else []
    by = W.partitionBy(*keys, *block).orderBy(*order)
    upto, before = by.rowsBetween(W.unboundedPreceding, W.currentRow), by.rowsBetween(W.unboundedPreceding, -1)
    own = {k: F.coalesce(F.sum(c).over(upto), F.lit(0)) for k, c in sums.items()} | {k: F.last(c, ignorenulls=True).over(before) for k, c in lasts.items()}
    out = rows.withColumns(own | {k: F.bit_or(c).over(before) for k, c in ors.items()})
    if not block:
        return out
    held = {k: F.sum(c) for k, c in sums.items()} | {k: F.bit_or(c) for k, c in ors.items()}
    held |= {k: F.max(F.when(c.isNotNull(), F.struct(*order, c.alias("v")))) for k, c in lasts.items()}
    totals = rows.where("block is not null").groupBy(*keys, "block").agg(*(c.alias(f"held_{k}") for k, c in held.items()))
    earlier = W.partitionBy(*keys).orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    carried = {k: F.sum(f"held_{k}").over(earlier) for k in sums} | {k: F.last(f"held_{k}", ignorenulls=True).over(earlier) for k in lasts}
    carried |= {k: F.bit_or(f"held_{k}").over(earlier) for k in ors}
    carry = totals.select(*(F.col(k).alias(f"of_{k}") for k in (*keys, "block")), *(c.alias(f"carry_{k}") for k, c in carried.items()))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in (*keys, "block")))
    both = out.join(carry, same, "left")
    merged = {k: F.col(k) + F.coalesce(f"carry_{k}", F.lit(0)) for k in sums} | {k: F.coalesce(F.col(k), F.col(f"carry_{k}.v")) for k in lasts}
    merged |= {k: F.when(F.col(k).isNull(), F.col(f"carry_{k}")).otherwise(F.col(k).bitwiseOR(F.coalesce(f"carry_{k}", F.lit(0)))) for k in ors}
    return both.withColumns(merged).drop(*(f"of_{k}" for k in (*keys, "block")), *(f"carry_{k}" for k in carried))


def ranged(rows: DataFrame, order: list[str], scratch: Scratch, parts: int | None = None) -> DataFrame:
    """``rows`` with ``block``: which of ``parts`` ranges of the order a row lies in. Written, so
    that every later look at it finds the same ranges."""
    parts = parts or max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scratch.keep(rows.repartitionByRange(parts, *order).withColumn("block", F.spark_partition_id()), "ranged")


def _totals(rows: DataFrame, value: Column) -> dict[int, int]:
    """Each range's sum: a row a range."""
    return {r["block"]: int(r["n"] or 0) for r in rows.groupBy("block").agg(F.sum(value).alias("n")).collect()}


def _before(totals: dict[int, int]) -> dict[int, int]:
    """What the ranges before each range come to."""
    blocks = sorted(totals)
    return dict(zip(blocks, accumulate((totals[b] for b in blocks), initial=0)))


def prefix_sums(rows: DataFrame, order: list[str], value: Column, scratch: Scratch, upto: int | None = None, parts: int | None = None) -> DataFrame:
    """``rows`` with ``upto``, the sum of ``value`` (0 or more) of all rows up to and with each, in an
    order of the whole table. Each range is summed on its own, and what the ranges before it
    come to is carried over. With a bound, rows beyond it are left out, whole ranges unread."""
    cut = ranged(rows, order, scratch, parts)
    before = _before(_totals(cut, value))
    if upto is not None:
        before = {b: n for b, n in before.items() if n <= upto}
    if not before:
        return cut.limit(0).withColumn("upto", F.lit(0).cast("long")).drop("block")
    carried = F.element_at(F.create_map(*(F.lit(x).cast("long") for pair in before.items() for x in pair)), F.col("block").cast("long"))
    within = F.sum(value).over(W.partitionBy("block").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    out = cut.where(F.col("block").isin(list(before))).withColumn("upto", within + carried).drop("block")
    return out if upto is None else out.where(F.col("upto") <= upto)


def nearest_ranks(values: DataFrame, shares: list[float], scratch: Scratch, parts: int | None = None) -> list:
    """Exact order statistics of a column without nulls: for each share p the value at place
    ``round(p * (n - 1))`` of n in order, None if there are none. Equal values are counted
    first; only the ranges that hold a wanted place are looked into, one value a place comes
    back."""
    (name,) = values.columns
    cut = ranged(values.groupBy(name).agg(F.count("*").alias("c")), [name], scratch, parts)
    totals = _totals(cut, F.col("c"))
    n, before = sum(totals.values()), _before(totals)
    if not n:
        return [None] * len(shares)
    places = [int(p * (n - 1) + 0.5) for p in shares]
    of = [max(b for b in before if before[b] <= k and totals[b]) for k in places]
    within = F.sum("c").over(W.partitionBy("block").orderBy(name).rowsBetween(W.unboundedPreceding, W.currentRow))
    some = cut.where(F.col("block").isin(sorted(set(of)))).withColumn("upto", within)
    picked = some.agg(*(F.min(F.when((F.col("block") == b) & (F.col("upto") > k - before[b]), F.col(name))).alias(f"v{i}") for i, (k, b) in enumerate(zip(places, of))))
    return list(picked.first())


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int = 256) -> DataFrame:
    """Pairs of rows of equal keys whose inclusive ranges ``low, high`` meet; columns of ``left`` and,
    as ``other_low, other_high`` and so on, those of ``right``.

    Both are dealt to bins of ``width`` places, so a key's rows are many tasks' work and only rows
    of one bin meet; a pair is told in the bin where the later of the two begins. A range costs a
    row a bin. Ranges that end before they begin meet nothing."""
    bins = lambda df: df.where("low <= high").withColumn("bin", F.explode(F.sequence(F.call_function("div", F.col("low"), F.lit(width)), F.call_function("div", F.col("high"), F.lit(width)))))
    other = bins(right.withColumnsRenamed({c: f"other_{c}" for c in right.columns if c not in keys} | {"low": "low", "high": "high"}))
    other = other.withColumnsRenamed({"low": "other_low", "high": "other_high"})
    both = bins(left).join(other, [*keys, "bin"])
    later = F.greatest("low", "other_low")
    meets = (F.col("low") <= F.col("other_high")) & (F.col("other_low") <= F.col("high")) & (F.call_function("div", later, F.lit(width)) == F.col("bin"))
    return both.where(meets).drop("bin")
