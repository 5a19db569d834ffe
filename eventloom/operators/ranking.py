"""First, last, next and numbered rows within groups.

A group may hold a large share of all rows, so no operator here sorts a whole group in
one task: first rows come from aggregates that combine before the shuffle, the first n
from a ranked limit that Spark also applies before the shuffle, and numbering from
blocks of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def drop_repeats(df: DataFrame, keys: list[str], order: str, blank: str | None = None) -> DataFrame:
    """The first row per key in feed order.

    `blank` names the key column whose empty values mean "no key": such rows all stay.
    `order` is unique within its feed, which keeps them apart.
    """
    grouping = [F.col(k) for k in keys]
    if blank:
        none = F.nullif(F.col(blank).cast("string"), F.lit("")).isNull()
        grouping.append(F.when(none, F.col(order)).alias("_apart"))
    row = F.struct(*df.columns)
    named = [g.alias(f"_k{i}") for i, g in enumerate(grouping)]
    return df.groupBy(*named).agg(F.min_by(row, F.col(order)).alias("_row")).select("_row.*")


def first_n(df: DataFrame, group: list[str], order: list[Column], n: int | None) -> DataFrame:
    """The first `n` rows of each group (None: all). Spark limits each group before the shuffle too."""
    if n is None:
        return df
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col("_n") <= n).drop("_n")


def last_n(df: DataFrame, group: list[str], order: list[str], n: int | None) -> DataFrame:
    """The last `n` rows of each group (None: all)."""
    return first_n(df, group, [F.col(c).desc() for c in order], n)


def number_rows(
    df: DataFrame, group: list[str], order: str, name: str = "row_no", block: int | Column = 100_000
) -> DataFrame:
    """Number the rows of each group from 1 in the order of a column.

    A whole-number `order` is cut into blocks of `block` values; for any other, `block` is a
    column that rises with it. Counts per block give each block its offset, and rows are
    numbered inside their block only, so no task sorts more than one block however large
    the group. `order` is unique within a group.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block) if isinstance(block, int) else block)
    keys = [*group, "_block"]
    offsets = (
        blocked.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(
                    Window.partitionBy(*group).orderBy("_block")
                    .rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ),
        )
        .drop("_rows")
    )
    inside = blocked.withColumn(
        "_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    )
    return (
        inside.join(offsets, keys)
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("long"))
        .select(*df.columns, name)
    )


def chunk_id(df: DataFrame, group: list[str], order: str, size: int, **kwargs) -> DataFrame:
    """Number the consecutive batches of `size` rows within each group, from 0."""
    numbered = number_rows(df, group, order, "_row", **kwargs)
    return numbered.withColumn("chunk", F.floor((F.col("_row") - 1) / size)).drop("_row")


def next_date(dates: Column, as_of: Column) -> Column:
    """The earliest (start_date, start_time) of an array not before `as_of`; first listed on ties."""
    numbered = F.transform(
        dates,
        lambda d, i: F.struct(
            d["start_date"].alias("start_date"), i.alias("i"), d["start_time"].alias("start_time")
        ),
    )
    ahead = F.filter(numbered, lambda d: d["start_date"] >= as_of.cast("string"))
    return F.array_min(ahead)
