"""Ordered scans that do not put a whole key into one task.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task.  Here
an order-preserving ``block`` column cuts each key into runs of bounded size:

1. scan inside (key, block);
2. reduce every block to one summary row and scan the summaries per key;
3. add the carried summary to the local result.

Step 2 sees one row per block, so a key with billions of rows still spreads over
as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 4096


def index_block(col: str | Column, size: int = BLOCK_ROWS) -> Column:
    """Block number for a dense integer position."""
    c = F.col(col) if isinstance(col, str) else col
    return F.floor(c / F.lit(size)).cast("long")


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    descending: bool = False,
    leads: Mapping[str, Column] | None = None,
    nexts: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running sums, last non-null values and previous-row values in key order, and the same from behind.

    ``sums``  out -> running total up to and including the row
    ``lasts`` out -> latest non-null value up to and including the row
    ``lags``  out -> value of the row before (null on the first row of a key)
    ``nexts`` out -> first non-null value at the row or after it
    ``leads`` out -> value of the row after (null on the last row of a key)

    ``block`` must be monotone in ``order``.  With ``descending`` everything runs
    from the end of the key, so ``lags`` returns the following row.
    """
    sums, lasts, lags, nexts, leads = (dict(m or {}) for m in (sums, lasts, lags, nexts, leads))
    keys, order = list(keys), list(order)
    named = df.withColumn("__block", block)
    for out, expr in {**sums, **lasts, **lags, **nexts, **leads}.items():
        named = named.withColumn(f"__in_{out}", expr)

    def directed(c: str, down: bool = descending) -> Column:
        return F.col(c).desc() if down else F.col(c).asc()

    local = Window.partitionBy(*keys, "__block").orderBy(*[directed(c) for c in order])
    back = Window.partitionBy(*keys, "__block").orderBy(*[directed(c, not descending) for c in order])
    upto, from_end = (w.rowsBetween(Window.unboundedPreceding, Window.currentRow) for w in (local, back))
    position = F.struct(*[F.col(c) for c in order])
    pick, pick_first = (F.min_by, F.max_by) if descending else (F.max_by, F.min_by)

    pieces, carried = [], {}
    for out in sums:
        pieces.append(F.sum(f"__in_{out}").alias(f"__s_{out}"))
    for out in [*lasts, *nexts]:
        one = pick if out in lasts else pick_first
        pieces.append(one(F.col(f"__in_{out}"), F.when(F.col(f"__in_{out}").isNotNull(), position)).alias(f"__s_{out}"))
    for out in [*lags, *leads]:
        one = pick if out in lags else pick_first
        pieces.append(one(F.struct(F.col(f"__in_{out}").alias("v")), position).alias(f"__s_{out}"))
    summary = named.groupBy(*keys, "__block").agg(*pieces)

    before, after = (Window.partitionBy(*keys).orderBy(directed("__block", down)).rowsBetween(Window.unboundedPreceding, -1) for down in (descending, not descending))
    for out in sums:
        carried[out] = F.sum(f"__s_{out}").over(before)
    for out in [*lasts, *lags]:
        carried[out] = F.last(f"__s_{out}", ignorenulls=True).over(before)
    for out in [*nexts, *leads]:
        carried[out] = F.last(f"__s_{out}", ignorenulls=True).over(after)
    summary = summary.select(*keys, "__block", *[c.alias(f"__c_{o}") for o, c in carried.items()])

    out_df = named
    if lags:
        out_df = out_df.withColumn("__row", F.row_number().over(local))
    for out in sums:
        out_df = out_df.withColumn(out, F.sum(f"__in_{out}").over(upto))
    for out in lasts:
        out_df = out_df.withColumn(out, F.last(f"__in_{out}", ignorenulls=True).over(upto))
    for out in lags:
        out_df = out_df.withColumn(out, F.lag(f"__in_{out}").over(local))
    if leads:
        out_df = out_df.withColumn("__back", F.row_number().over(back))
    for out in nexts:
        out_df = out_df.withColumn(out, F.last(f"__in_{out}", ignorenulls=True).over(from_end))
    for out in leads:
        out_df = out_df.withColumn(out, F.lag(f"__in_{out}").over(back))
    out_df = out_df.join(summary, [*keys, "__block"], "left")
    for out in sums:
        out_df = out_df.withColumn(out, F.coalesce(F.col(f"__c_{out}") + F.col(out), F.col(out), F.col(f"__c_{out}")))
    for out in [*lasts, *nexts]:
        out_df = out_df.withColumn(out, F.coalesce(F.col(out), F.col(f"__c_{out}")))
    for out in [*lags, *leads]:
        out_df = out_df.withColumn(
            out, F.when(F.col("__row" if out in lags else "__back") == 1, F.col(f"__c_{out}.v")).otherwise(F.col(out)))
    return out_df.select(*df.columns, *[o for o in {**sums, **lasts, **lags, **nexts, **leads} if o not in df.columns])


def row_index(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str], out: str,
              start: int = 0) -> DataFrame:
    """Dense position of every row inside its key, starting at ``start``."""
    numbered = block_scan(df, keys, block, order, sums={out: F.lit(1).cast("long")})
    return numbered.withColumn(out, F.col(out) - F.lit(1 - start))


def with_halo(df: DataFrame, index: str, before: int = 0, after: int = 0, size: int = BLOCK_ROWS) -> DataFrame:
    """Copy rows near a block border into the neighbouring block.

    Adds ``block`` (where the row is evaluated) and ``is_halo``.  A window over
    (key, block) then sees ``before`` rows ahead of the block and ``after`` rows
    behind it; drop ``is_halo`` rows afterwards.
    """
    home = index_block(index, size)
    offset = F.col(index) % F.lit(size)
    absent = F.lit(None).cast("long")
    targets = F.array(
        home,
        F.when(offset >= size - before, home + 1).otherwise(absent) if before else absent,
        F.when((offset < after) & (home > 0), home - 1).otherwise(absent) if after else absent)
    return (df.withColumn("block", F.explode(F.filter(targets, lambda b: b.isNotNull())))
            .withColumn("is_halo", F.col("block") != home))
