"""Windows along sequences of any length: a sequence is cut into blocks of SIZE places, which carry sums and edge rows over.

A row's place in its sequence comes from range partitions (ranks.ranked), so that a sequence
of a third of all rows is never sorted in one task. A window that looks a few rows back or
ahead runs over each block with copies of those rows from the blocks beside it; a running sum
runs over each block and gets the total of the blocks before. While no sequence is longer
than a block, all of them are one block and the plain window is used, which gives the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvox.operators.ranks import ranked

SIZE = 1 << 16


class Blocks:
    """rows of sequences `by` in order (total within a sequence), with a block number and copies from the blocks beside it."""

    def __init__(self, rows: DataFrame, by: str, order: str, back: int = 0, ahead: int = 0):
        if max(back, ahead) > SIZE:
            raise ValueError("a window reaches beyond the next block")
        self.by, self.order = by, order
        self.sizes = rows.groupBy(by).agg(F.count("*").alias("n_"))
        longest = self.sizes.agg(F.max("n_")).first()[0] or 0
        self.many = longest > SIZE
        if not self.many:
            self.rows = rows.withColumns({"block_": F.lit(0).cast("long"), "own_": F.lit(True)})
        else:
            p = ranked(rows, order, by=(by,)).withColumnRenamed("place", "place_")
            block, inside = F.floor(F.col("place_") / SIZE), F.col("place_") % SIZE
            more = F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.when(inside >= SIZE - back, F.struct((block + 1).alias("b"), F.lit(False).alias("own"))), F.when((inside < ahead) & (block > 0), F.struct((block - 1).alias("b"), F.lit(False).alias("own"))))
            p = p.withColumn("at_", F.explode(F.array_compact(more)))
            self.rows = p.withColumns({"block_": F.col("at_.b"), "own_": F.col("at_.own")}).drop("at_")
        self.window = Window.partitionBy(by, "block_").orderBy(order)

    def place(self) -> Column:
        """0-based place in the sequence."""
        return F.col("place_") if self.many else (F.row_number().over(self.window) - 1).cast("long")

    def of_all(self, rows: DataFrame, each: dict[str, Column]) -> DataFrame:
        """rows with aggregates of their whole sequence."""
        if not self.many:
            return rows.withColumns({k: v.over(Window.partitionBy(self.by)) for k, v in each.items()})
        return joined(rows, rows.where("own_").groupBy(self.by).agg(*(v.alias(k) for k, v in each.items())), self.by)

    def own(self, rows: DataFrame) -> DataFrame:
        """rows without copies and without the columns that blocks need."""
        return rows.where("own_").drop("block_", "own_", "place_")

    def running(self, rows: DataFrame, name: str, value: Column) -> DataFrame:
        """rows with the running sum of a value, this row's included."""
        part = F.when(F.col("own_"), value)
        rows = rows.withColumn(name, F.sum(part).over(self.window.rowsBetween(Window.unboundedPreceding, 0)))
        if not self.many:
            return rows
        total = rows.where("own_").groupBy(self.by, "block_").agg(F.sum(value).alias("sum_"))
        before = F.coalesce(F.sum("sum_").over(Window.partitionBy(self.by).orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = joined(rows, total.select(self.by, "block_", before.alias("before_")), self.by, "block_")
        return rows.withColumn(name, F.col(name) + F.col("before_")).drop("before_")


def joined(rows: DataFrame, more: DataFrame, *keys: str) -> DataFrame:
    """rows with the columns of `more` for their keys, null keys too."""
    more = more.select(*(F.col(k).alias(k + "_key") for k in keys), *(c for c in more.columns if c not in keys))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(k + "_key"))
    return rows.join(more, same).drop(*(k + "_key" for k in keys))
