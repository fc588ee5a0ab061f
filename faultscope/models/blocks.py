"""Training rows as blocks of numpy arrays, for fits that pass over all rows many times.

A block holds some thousand rows in the form a learner needs; blocks stay in
Spark's cache (memory, then disk), and a pass sends parameters to them and
gets sums back, whatever the number of rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, and most rows of a task beyond two tasks a core.
BLOCK, TASK_ROWS = 16_384, 1_000_000


def training_rows(dataset: DataFrame, columns: list[str] | None, vector: str, label: str, *more: str) -> DataFrame:
    """``x, y`` and ``more`` columns. Named columns are read as they are, which is much cheaper than by way of the vector."""
    x = F.array(*[F.col(c).cast("double") for c in columns]) if columns else vector_to_array(vector)
    return dataset.select(x.alias("x"), F.col(label).cast("double").alias("y"), *more)


def blocks_of(rows: DataFrame, width: int, count: int, make: Callable[..., tuple], *more: str) -> RDD:
    """``make(x, y, ...)`` for blocks of ``rows`` (``x`` array of ``width`` doubles, ``y`` double, ``more`` numbers), dealt evenly over tasks."""

    def pack(batches):
        def packed(held):
            parts = [np.concatenate(p) for p in zip(*held, strict=True)]
            content = [pickle.dumps(make(*(p[a : a + BLOCK] for p in parts)), 5) for a in range(0, len(parts[0]), BLOCK)]
            for one in content:
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.binary())], ["block"])

        held, rows_held = [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            held.append((x, *(batch.column(j).to_numpy(zero_copy_only=False) for j in range(1, batch.num_columns))))
            rows_held += batch.num_rows
            if rows_held >= BLOCK:
                yield from packed(held)
                held, rows_held = [], 0
        if rows_held:
            yield from packed(held)

    parallel = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(-(-count // BLOCK), max(2 * parallel, count // TASK_ROWS)))
    dealt = rows.select("x", "y", *more).mapInArrow(pack, "block binary").repartition(tasks)
    return dealt.rdd.map(lambda row: pickle.loads(row["block"])).persist(StorageLevel.MEMORY_AND_DISK)


def add_up(blocks: RDD, of_block: Callable[[tuple], tuple], how: tuple | None = None) -> tuple:
    """The tuple of arrays ``of_block`` gives, summed (or combined by the functions ``how``) over all blocks."""

    def both(a, b):
        return tuple(f(x, y) for f, x, y in zip(how or (np.add,) * len(a), a, b, strict=True))

    def of_task(part):
        total = None
        for block in part:
            one = of_block(block)
            total = one if total is None else both(total, one)
        if total is not None:
            yield total

    sums = blocks.mapPartitions(of_task)
    # Beyond some tasks their sums are combined in tasks first: what the driver receives does not grow with them.
    return sums.treeReduce(both, 2) if blocks.getNumPartitions() > 64 else sums.reduce(both)
