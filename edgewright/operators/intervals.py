"""Points and spans met in dyadic cells: by equality, with a logarithm of cells a span and a point, and no pairs that do not hold one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def span_cells(start: Column, end: Column, levels: int) -> Column:
    """The fewest cells (level, cell) of 2**level whole numbers that make up ``start`` to ``end``, two a level at most; none if the span is empty."""

    def at(k: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        low, high = F.ceil(start / width), F.floor((end + 1) / width)
        left = F.when((low % 2 == 1) & (low < high), low)
        right = F.when((high % 2 == 1) & (low + F.abs(low % 2) < high), high - 1)
        return F.transform(F.array_compact(F.array(left, right)), lambda c: F.struct(k.alias("level"), c.cast("long").alias("cell")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), at))


def point_cells(point: Column, levels: int) -> Column:
    """The cell of each level that a point lies in."""
    return F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda k: F.struct(k.alias("level"), F.call_function("shiftright", point.cast("long"), k).alias("cell")))


def stabbed(points: DataFrame, spans: DataFrame, keys: list[str], point: str, start: str, end: str, least: Column | None = None) -> DataFrame:
    """All (point, span) rows of equal ``keys`` whose span holds the point; columns of both, whose other names must differ.

    Numbers are not negative. A file with n points and n spans costs a row for each level that its spans reach, not their product. The longest span
    tells how many levels there are. Where only the least span by some order is asked for, ``least`` is that order, a struct of the spans' columns: each cell then has
    the least of its spans alone, in a column ``least``, so a point meets a row a level at most, however many spans hold it.
    """
    longest = spans.agg(F.max(F.col(end) - F.col(start) + 1)).head()[0] or 1
    levels = max(1, int(longest)).bit_length()
    left = points.where(F.col(point).isNotNull()).withColumn("__c", F.explode(point_cells(F.col(point), levels))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    right = spans.withColumn("__c", F.explode(span_cells(F.col(start), F.col(end), levels))).withColumns({"__level": F.col("__c.level"), "__cell": F.col("__c.cell")}).drop("__c")
    cell = [*keys, "__level", "__cell"]
    if least is not None:
        # Dealt out first: cells are seldom shared, and a minimum of structs sorts what it is given, so before the shuffle it would hold all cells of a task's input.
        right = right.select(*cell, least.alias("least")).repartition(*cell).groupBy(*cell).agg(F.min("least").alias("least"))
    return left.join(right, cell).drop("__level", "__cell")
