"""Telling rows apart that repeat an id, without a window over all rows of one id.

A row's identity is a hash of its id and further columns. Rows of equal identity are numbered from 0: ranks are taken
within runs of at most RUN rows as they stand in their partitions, and added to the counts of the runs before, so a row
that fills a third of the table still makes many small tasks. Only rows that repeat are shuffled for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilspark.llm.util import checkpointed, unused

RUN_BITS = 12


def marked(column: str | Column) -> Column:
    """A value as text that no null equals."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def repeated(rows: DataFrame, identity: str) -> DataFrame | None:
    """The identities that more than one row has; None: no row repeats."""
    found = checkpointed(rows.groupBy(identity).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(identity))
    return None if found.isEmpty() else found


def numbered(rows: DataFrame, identity: str, repeats: DataFrame | None, number: str) -> DataFrame:
    """rows with a column `number`: 0, 1, ... within each identity; rows of equal identity are alike in what it hashes, so
    which of them gets which number doesn't matter."""
    if repeats is None:
        return rows.withColumn(number, F.lit(0).cast("long"))
    here, run, n, before = unused(rows, "here", "run", "n", "before")
    own = rows.join(repeats, identity, "left_semi").withColumn(here, F.monotonically_increasing_id())
    own = checkpointed(own.withColumn(run, F.shiftright(here, RUN_BITS)))
    counts = own.groupBy(identity, run).agg(F.count(F.lit(1)).alias(n))
    counts = counts.select(identity, run, (F.sum(n).over(Window.partitionBy(identity).orderBy(run)) - F.col(n)).alias(before))
    rank = F.row_number().over(Window.partitionBy(identity, run).orderBy(here)) - 1
    own = own.withColumn(number, rank).join(counts, [identity, run]).withColumn(number, F.col(before) + F.col(number))
    return rows.join(repeats, identity, "left_anti").withColumn(number, F.lit(0).cast("long")).unionByName(own.drop(here, run, before))
