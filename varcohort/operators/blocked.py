"""Ordered operations in two levels, so that no key is one task's work.

Rows of a key are cut into blocks of positions. Sums and neighbours inside a block come from a window over that
block; what crosses blocks comes from the window's own first row of each block, so the rows are shuffled once and both
uses read that shuffle. Positions must be unique within a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def blocks(df: DataFrame, pos: str, size: int) -> DataFrame:
    return df.withColumn("__block", F.floor(F.col(pos) / F.lit(size)))


def running_sum(df: DataFrame, by: str, pos: str, columns: list[str], size: int = BLOCK) -> DataFrame:
    """Adds ``run_<c>``: the sum of each column over the key's rows up to this one."""
    block = Window.partitionBy(by, "__block")
    upto = block.orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks(df, pos, size).select("*", F.row_number().over(block.orderBy(pos)).alias("__n"), *[F.sum(c).over(upto).alias(f"__r_{c}") for c in columns], *[F.sum(c).over(block).alias(f"__t_{c}") for c in columns])
    before = Window.partitionBy(by).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.where("__n = 1").select(by, "__block", *[F.coalesce(F.sum(f"__t_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in columns])
    return rows.join(offsets, [by, "__block"]).select(*df.columns, *[(F.col(f"__r_{c}") + F.col(f"__o_{c}")).alias(f"run_{c}") for c in columns])


def neighbour(df: DataFrame, by: str, pos: str, column: str, name: str, ahead: bool, size: int = BLOCK) -> DataFrame:
    """Adds ``name``: ``column`` of the key's previous (or, ``ahead``, next) row, null where there is none."""
    inside = Window.partitionBy(by, "__block").orderBy(F.desc(pos) if ahead else F.asc(pos))
    edge = F.last(column).over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = blocks(df, pos, size).select("*", F.row_number().over(inside).alias("__n"), F.lag(column).over(inside).alias("__near"), edge.alias("__edge"))
    order = Window.partitionBy(by).orderBy("__block")
    edges = rows.where("__n = 1").select(by, "__block", (F.lead if ahead else F.lag)("__edge").over(order).alias("__far"))
    out = rows.drop("__edge").join(edges, [by, "__block"])
    return out.select(*df.columns, F.when(F.col("__n") == 1, F.col("__far")).otherwise(F.col("__near")).alias(name))


def turns(df: DataFrame, by: str, pos: str, inside: Column, was: Column) -> DataFrame:
    """(key, start0, end0): stretches of positions from a row where ``inside`` begins to hold, ``was`` not, to where it ends."""
    now, then = F.coalesce(inside, F.lit(False)), F.coalesce(was, F.lit(False))
    turned = df.where(now != then).select(by, pos, now.alias("__in"))
    closed = neighbour(turned, by, pos, pos, "end0", True)
    return closed.where(F.col("__in") & F.col("end0").isNotNull()).select(by, F.col(pos).alias("start0"), "end0")


def value_blocks(df: DataFrame, value: str, n: int = 200) -> Column:
    """A block for each value: about ``n`` ranges of like numbers of rows, bounded by approximate quantiles, so that equal values share one."""
    bounds = sorted(set(df.approxQuantile(value, [i / n for i in range(1, n)], 0.5 / n)))
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col(value))) if bounds else F.lit(0)


def scan(df: DataFrame, by: list[str], pos: str, block: Column, column: str, name: str, how: str = "sum", ahead: bool = False) -> DataFrame:
    """Adds ``name``: the sum, max or min of ``column`` over the key's rows up to this one, or, ``ahead``, from it on.

    ``block`` numbers ranges of ``pos`` in order; positions are unique within a key.
    """
    fold, turn = {"sum": F.sum, "max": F.max, "min": F.min}[how], F.desc if ahead else F.asc
    own = Window.partitionBy(*by, "__block")
    order = own.orderBy(turn(pos))
    rows = df.withColumn("__block", block).select("*", F.row_number().over(order).alias("__n"), fold(column).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("__r"), fold(column).over(own).alias("__t"))
    before = Window.partitionBy(*by).orderBy(turn("__block")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.where("__n = 1").select(*by, "__block", fold("__t").over(before).alias("__o"))  # a row a block
    whole = {"sum": lambda: F.col("__r") + F.coalesce("__o", F.lit(0)), "max": lambda: F.greatest("__r", "__o"), "min": lambda: F.least("__r", "__o")}[how]()
    return rows.join(offsets, [*by, "__block"]).select(*df.columns, whole.alias(name))
