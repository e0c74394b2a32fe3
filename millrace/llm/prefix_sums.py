"""Running sums over a whole table in a given order, without a task that sees it all.

The table is range-sorted by group and order, so that a large group lies in many tasks. Every task adds up
along its rows; the tasks' totals of each group, one row for each task and group that meet, are added up in the
order of tasks and give each task's start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.shared import frugal, small_or_shuffled, stash


def _scan(values: np.ndarray, new: np.ndarray, carry: int) -> np.ndarray:
    """Sums of the values up to each row, itself left out, begun anew where ``new``; ``carry`` stands before the first row."""
    total = np.cumsum(values)
    before = total - values + carry
    at = np.flatnonzero(new)
    if len(at):
        begun = np.zeros(len(values), np.int64)
        begun[at[0] :] = np.repeat(before[at], np.diff(np.append(at, len(values))))
        before = before - begun
    return before


def prefix_sums(table: DataFrame, group: str, order: list[str], values: dict[str, str], partitions: int | None = None) -> DataFrame:
    """``table`` with a column ``values[c]`` for each long column c: the sum of c over the rows of the same ``group`` that come earlier by ``order``.

    ``group`` must not be null. Rows that tie in ``order`` come in any order, so ``order`` should name all columns by which rows that tie would differ.
    The result is written, so it is the same whenever it is read.
    """
    spark = table.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = table.repartitionByRange(n, group, *order).sortWithinPartitions(group, *order)
    names = list(values.values())
    schema = T.StructType([*table.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carry = None, dict.fromkeys(values, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column(group)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pa.compute.not_equal(groups.slice(1), groups.slice(0, len(groups) - 1)).to_numpy(zero_copy_only=False)
            new[0] = groups[0] != last
            added = []
            for c in values:
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64)
                before = _scan(v, new, carry[c])
                carry[c] = int(before[-1] + v[-1])
                added.append(pa.array(before))
            last = groups[len(groups) - 1]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], schema.names)

    within = stash(laid.mapInArrow(frugal(run), schema).withColumn("_part", F.spark_partition_id()), "prefix-sums")
    totals = within.groupBy("_part", group).agg(*[F.sum(c).alias(f"_{c}") for c in values])
    # one row for each task and each group it meets: fewer than tasks and groups together
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_part", group, *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in values])
    joined = within.join(small_or_shuffled(stash(starts, "prefix-starts")), ["_part", group])
    return joined.select(*table.columns, *[(F.col(name) + F.col(f"_{c}")).alias(name) for c, name in values.items()])
