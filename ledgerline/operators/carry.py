"""Carry the last known value forward in a long ordered group without putting the group into one task.

A window over a whole report would sort it in a single task, and one report may hold a large share of
all rows. Rows are therefore filled inside blocks of bounded size, and a block takes over from the blocks
before it what one summary row per block says. Rows are dealt to blocks once: both the filling and the
summaries read that one exchange, so the source is read and parsed a single time, and rows meet their
block's summary where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


#: Rows up to which a group is one block where its length is known.
SHORT = 1 << 16


def long_groups(df: DataFrame, group: str) -> DataFrame:
    """The groups of more than ``SHORT`` rows, so at most one for each ``SHORT`` rows of the data."""
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > SHORT).select(group)


def carry_forward(
    df: DataFrame, group: list[str], order: list[str], values: dict[str, Column], block: Column, keep: list[str] | None = None,
) -> DataFrame:
    """Add, for each entry of ``values``, its last non-null value up to and including the row. Columns beyond ``keep`` are left out.

    ``block`` cuts a group into runs of the sort order, for instance every sixteen pages, or a struct such as
    page, table and every thousand rows; null for all rows of a group leaves the group whole. One task holds the rows of
    one block, or the summaries of one group.
    """
    names = list(values)
    kept = df.columns if keep is None else keep
    # A struct in an array: of a bare struct Spark would keep other fields for each of the two readers of the exchange, and
    # prepare it twice. What the key or the order holds does not travel a second time.
    rest = [c for c in kept if c not in group and c not in order]
    whole = F.array(F.struct(*rest) if rest else F.struct(F.lit(None).cast("boolean").alias("_none")))
    # Group and block are one column, so that rows without a group keep together and every step finds the same dealing.
    dealt = df.select(
        F.struct(*group, block.alias("block")).alias("_key"), F.struct(*order).alias("_at"),
        F.struct(*[c.alias(n) for n, c in values.items()]).alias("_own"), whole.alias("_row")).repartition("_key")

    # A block that is a whole group tells nobody else anything; of such only rows with a value are looked at. An explode leaves
    # the others out, as a filter would move below the exchange and have it made twice.
    says = F.coalesce(*[F.col("_own")[n].cast("string") for n in names]).isNotNull() | F.col("_key")["block"].isNotNull()
    told = dealt.select("*", F.explode(F.when(says, F.array(F.lit(True)))).alias("_says"))
    # Summaries ask for the row as well; with less Spark would prepare the exchange a second time.
    last = [F.max_by(F.col("_own")[n], F.when(F.col("_own")[n].isNotNull(), F.col("_at"))).alias(n) for n in names]
    ends = told.groupBy("_key").agg(*last, F.max(F.size("_row")).alias("_seen")).filter("_seen IS NOT NULL").drop("_seen")
    earlier = Window.partitionBy(*[F.col("_key")[c] for c in group]).orderBy(F.col("_key")["block"]).rowsBetween(Window.unboundedPreceding, -1)
    over = ends.select("_key", F.struct(*[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in names]).alias("_over"))

    so_far = Window.partitionBy("_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("_key", "_at", "_row", F.struct(*[F.last(F.col("_own")[n], ignorenulls=True).over(so_far).alias(n) for n in names]).alias("_in"))
    # The columns come out of a generator: a later filter on one of them would move below one of the two readers only.
    row = F.get("_row", F.lit(0))
    held = {c: F.col("_key")[c] for c in group} | {c: F.col("_at")[c] for c in order} | {c: row[c] for c in rest}
    return inside.join(over, "_key", "left").select(
        F.inline(F.array(F.struct(*[held[c].alias(c) for c in kept]))), *[F.coalesce(F.col("_in")[n], F.col("_over")[n]).alias(n) for n in names])
