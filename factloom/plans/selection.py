"""Values at given ranks, exact, without sorting a scope in one task.

Amounts are whole numbers of cents. Rows are counted by value first, then by the highest bits of their values: the counts say in which range
of values a rank lies, and only that range is looked into, by its next bits. A task sorts the ranges of one range, never rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits that each round leaves out: a round tells 2^21 ranges apart at most.
SHIFTS = (42, 21, 0)


def counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, cents, n: how often each value occurs; rows without a value don't count. The largest value comes first, so its cents are the least."""
    return rows.where("value is not null").groupBy(*by, (-(F.col("value") * 100).cast("long")).alias("cents")).agg(F.count("*").alias("n"))


def middle(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, rank: the one or two ranks in the middle."""
    total = counts.groupBy(*by).agg(F.sum("n").alias("c"))
    return total.select(*by, F.explode(F.array_distinct(F.array(F.floor((F.col("c") + 1) / 2), F.floor((F.col("c") + 2) / 2)))).alias("rank"))


def at_ranks(counts: DataFrame, by: list[str], ranks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """by, rank, value of the ``ranks`` (by, rank; 1 is the largest value) that the ``counted`` rows have; equal values take a rank each.

    ``cells``: by, cell. The rows are then counted by cell (cell, cents, n), once for all groups, and a group has those of its cells; of the single
    values only those meet a group that lie in the range of its rank.
    """
    own = by if cells is None else ["cell"]
    asked = ranks.select(*by, F.col("rank").cast("long").alias("rank"), F.col("rank").cast("long").alias("rest"), F.lit(0).cast("long").alias("range"))
    parent = None
    for shift in SHIFTS:
        here, above = F.shiftright("cents", shift), F.lit(0).cast("long") if parent is None else F.shiftright("cents", parent)
        ranges = counts.groupBy(*own, above.alias("range"), here.alias("inner")).agg(F.sum("n").alias("n"))
        if cells is None:
            upto = F.sum("n").over(Window.partitionBy(*by, "range").orderBy("inner"))
            found = asked.join(ranges.withColumn("upto", upto), [*by, "range"])
        else:
            upto = F.sum("n").over(Window.partitionBy(*by, "rank").orderBy("inner"))
            found = asked.join(cells, by).join(ranges, ["cell", "range"]).groupBy(*asked.columns, "inner").agg(F.sum("n").alias("n")).withColumn("upto", upto)
        found = found.where("rest > upto - n and rest <= upto")
        asked = found.select(*by, "rank", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest"), F.col("inner").alias("range"))
        parent = shift
    return asked.select(*by, "rank", (-F.col("range").cast("decimal(18,0)") / 100).cast("decimal(18,2)").alias("value"))
