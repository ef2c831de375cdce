"""Order-based helpers that never need one whole group in one task.

A group is cut into blocks of its order column. Every block is handled on its own; what crosses
a block edge is settled on one or two rows per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_in_group(df: DataFrame, keys: Sequence[str], order: str, out: str, block: int = 256) -> DataFrame:
    """`df` with `out`: the following value of the integer column `order` in the row's group, null at its end.

    (keys, order) must be unique. Null keys form a group of their own; rows with a null order get null.
    """
    cols = df.columns
    on = [*keys, "_blk"]
    cut = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    inner = cut.withColumn("_nx", F.lead(order).over(Window.partitionBy(*on).orderBy(order)))
    heads = cut.groupBy(*on).agg(F.min(order).alias("_head"))
    heads = heads.withColumn("_after", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_blk")))
    h = heads.select(*[F.col(k).alias(f"_h_{k}") for k in on], "_after")
    same = [F.col(k).eqNullSafe(F.col(f"_h_{k}")) for k in on]
    cond = same[0]
    for x in same[1:]:
        cond = cond & x
    return inner.join(h, cond, "left").select(*cols, F.coalesce("_nx", "_after").alias(out))


def running(df: DataFrame, keys: Sequence[str], block: Column, order: Sequence[str | Column], value: Column, out: str) -> DataFrame:
    """`df` with `out`: the sum of `value` over the rows of the group up to this one.

    `block` must rise with `order`; each block is summed by itself, and only its total goes on to the next ones. Rows with a null
    key have no place.
    """
    on = [*keys, "_blk"]
    x = df.withColumn("_blk", block).withColumn("_v", value)
    whole = x.groupBy(*on).agg(F.sum("_v").alias("_all"))
    whole = whole.withColumn("_before", F.coalesce(F.sum("_all").over(Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_all")
    w = Window.partitionBy(*on).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn(out, F.sum("_v").over(w)).join(whole.hint("shuffle_hash"), on).withColumn(out, F.col(out) + F.col("_before")).drop("_blk", "_v", "_before")


def numbered(df: DataFrame, keys: Sequence[str], order: str, out: str, block: int = 256) -> DataFrame:
    """`df` with `out`: the row's number, from 1, in its group by the integer column `order`."""
    x = running(df, keys, F.floor(F.col(order) / F.lit(block)), [order], F.lit(1), out)
    return x.withColumn(out, F.col(out).cast("int"))


def previous(df: DataFrame, keys: Sequence[str], order: str, cols: dict[str, str], block: int = 256) -> DataFrame:
    """`df` with columns of the row before in its group: cols names them, {new name: column}. (keys, order) must be unique.

    From block to block goes one row with the block's last values. Rows with a null key have no place.
    """
    on = [*keys, "_blk"]
    x = df.withColumn("_blk", F.floor(F.col(order) / F.lit(block)))
    here = F.struct(*[F.col(c).alias(n) for n, c in cols.items()])
    tails = x.groupBy(*on).agg(F.max_by(here, order).alias("_tail"))
    tails = tails.select(*on, F.lag("_tail").over(Window.partitionBy(*keys).orderBy("_blk")).alias("_back"))
    w = Window.partitionBy(*on).orderBy(order)
    x = x.withColumn("_p", F.lag(here).over(w)).join(tails.hint("shuffle_hash"), on)
    p = F.coalesce("_p", "_back")
    return x.select(*df.columns, *[p[n].alias(n) for n in cols])


def coalesce_intervals(df: DataFrame, keys: Sequence[str], value: str, start: str, end: str, block: int = 256, before: str | None = None) -> DataFrame:
    """Join touching intervals of the same value: rows (keys, value, start, end), end null where open.

    An interval is continued by the one whose start equals its end and whose value is the same.
    Within a group starts are unique and no value is null. Each block of starts is coalesced by itself, in
    one sorted pass; only what may go on beyond the edges of its block takes part in a second one. `before`
    names a column with the start of the interval that could be continued, so that whatever begins in the
    block it stands in is left out of the second pass.
    """
    on = [*keys, "_blk"]
    w = Window.partitionBy(*on).orderBy(start)
    x = df.select(*keys, value, start, end, *([before] if before else [])).withColumn("_blk", F.floor(F.col(start) / F.lit(block)))

    def ends(x: DataFrame, w: Window) -> DataFrame:
        """The first and last intervals of every run."""
        goes_on = (F.lag(end).over(w) == F.col(start)) & (F.lag(value).over(w) == F.col(value))
        gone_on = (F.lead(start).over(w) == F.col(end)) & (F.lead(value).over(w) == F.col(value))
        return x.withColumn("_first", ~F.coalesce(goes_on, F.lit(False))).withColumn("_last", ~F.coalesce(gone_on, F.lit(False))).where("_first or _last")

    def joined(x: DataFrame, w: Window) -> DataFrame:
        return x.withColumn("_end", F.when(F.col("_last"), F.col(end)).otherwise(F.lead(end).over(w))).where("_first")

    left = (F.lag(start).over(w).isNull()) if before is None else (F.floor(F.col(before) / F.lit(block)) < F.col("_blk"))
    x = joined(ends(x.withColumn("_left", F.coalesce(left, F.lit(False))), w), w)
    across = F.col("_left") | F.coalesce(F.floor(F.col("_end") / F.lit(block)) > F.col("_blk"), F.lit(False))
    # What is whole stays with its block, where nothing continues it: a single flow, so that nothing before is computed twice.
    x = x.select(*keys, value, start, F.col("_end").alias(end), F.when(~across, F.col("_blk")).alias("_part"))
    by = Window.partitionBy(*keys, "_part").orderBy(start)
    return joined(ends(x, by), by).select(*keys, value, start, F.col("_end").alias(end))
