"""Count-min sketches of 64-bit keys, made by partitions and merged by Spark.

A sketch has two rows of counters. Each task counts the keys of its partition and gives only the
counters that are not zero, cut into blocks; blocks of one number are added up by a grouped job.
Counters stop at 255, so an estimate is never below min(count, 255), and no key is estimated too low.

The width follows the number of keys without a bound, so estimates are as good at any size. A key's
counters lie in the same place of each row's blocks, its slot. Up to `MAX_WIDTH` the whole sketch is
broadcast. A wider one stays where it is: rows with keys are dealt to the slots and meet their blocks
there (`dealt`), one block of each row in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hashing import MULTIPLIERS, mix

DEPTH = 2
#: Counters of a block.
BLOCK = 1 << 16
#: The widest row that is broadcast; with DEPTH rows of one byte, 64 MB at most.
MAX_WIDTH = 1 << 25

#: Tasks whose counters are added up together first.
GROUP = 256

BLOCK_SCHEMA = "tasks int, block int, places binary, counts binary"


def width_for(keys: float, most: int | None = None) -> int:
    """Counters in a row: the power of two that leaves at least two for each key, `most` where given."""
    width = BLOCK
    while width < 2 * keys and (most is None or width < most):
        width *= 2
    return width


def slots(keys: np.ndarray, width: int) -> np.ndarray:
    """The block of each key in every row."""
    return (mix(keys) & np.uint64(width // BLOCK - 1)).astype(np.int64)


def inside(keys: np.ndarray, row: int) -> np.ndarray:
    """The counter of each key in its block of a row."""
    return (mix(keys * np.uint64(MULTIPLIERS[row]) + np.uint64(row + 1)) & np.uint64(BLOCK - 1)).astype(np.int64)


def cells(keys: np.ndarray, row: int, width: int) -> np.ndarray:
    return slots(keys, width) * BLOCK + inside(keys, row)


class Counting:
    """The sparse counters of one task."""

    def __init__(self, width: int):
        self.width = width
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.places = np.zeros(0, np.int64)
        self.counts = np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        for row in range(DEPTH):
            self.waiting.append(cells(keys, row, self.width) + row * self.width)
        self.held += DEPTH * len(keys)
        if self.held > 1 << 21:
            self._settle()

    def _settle(self) -> None:
        if self.waiting:
            places, counts = np.unique(np.concatenate(self.waiting), return_counts=True)
            both = np.concatenate([self.places, places])
            more = np.concatenate([self.counts, counts])
            self.places, at = np.unique(both, return_inverse=True)
            self.counts = np.minimum(255, np.bincount(at, more, len(self.places)).astype(np.int64))
            self.waiting, self.held = [], 0

    def blocks(self) -> Iterator[pa.RecordBatch]:
        self._settle()
        block = self.places // BLOCK
        tasks = TaskContext.get().partitionId() // GROUP
        bounds = np.append(np.flatnonzero(np.append(True, block[1:] != block[:-1])), len(block)) if len(block) else np.zeros(1, np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield pa.RecordBatch.from_arrays(
                [pa.array([tasks], pa.int32()), pa.array([int(block[a])], pa.int32()), pa.array([(self.places[a:b] % BLOCK).astype("<u2").tobytes()], pa.binary()), pa.array([self.counts[a:b].astype(np.uint8).tobytes()], pa.binary())],
                names=["tasks", "block", "places", "counts"],
            )


def merged(parts: DataFrame) -> DataFrame:
    """One row for each block, with all counters that are not zero: first of groups of tasks, then of all."""

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for places, counts in zip(table.column("places"), table.column("counts")):
            total[np.frombuffer(places.as_py(), "<u2")] += np.frombuffer(counts.as_py(), np.uint8)
        there = np.flatnonzero(total)
        return pa.table({"tasks": pa.array([0], pa.int32()), "block": pa.array([table.column("block")[0].as_py()], pa.int32()), "places": pa.array([there.astype("<u2").tobytes()], pa.binary()), "counts": pa.array([np.minimum(total[there], 255).astype(np.uint8).tobytes()], pa.binary())})

    return parts.groupBy("tasks", "block").applyInArrow(add, BLOCK_SCHEMA).groupBy("block").applyInArrow(add, BLOCK_SCHEMA)


class Sketch:
    """A whole sketch in memory: at most DEPTH * MAX_WIDTH bytes."""

    def __init__(self, width: int, table: np.ndarray):
        self.width, self.table = width, table

    @classmethod
    def gathered(cls, parts: DataFrame, width: int) -> Sketch:
        """Merges the parts on the executors and gathers the blocks, whose size is bounded by the width, which is checked."""
        if width > max(MAX_WIDTH, BLOCK):
            raise ValueError(f"a sketch of width {width} is not to be gathered")
        table = np.zeros(DEPTH * width, np.uint8)
        for r in merged(parts).collect():
            table[r.block * BLOCK + np.frombuffer(bytes(r.places), "<u2").astype(np.int64)] = np.frombuffer(bytes(r.counts), np.uint8)
        return cls(width, table)

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        """Counts, never too low below 255."""
        out = self.table[cells(keys, 0, self.width)]
        for row in range(1, DEPTH):
            out = np.minimum(out, self.table[cells(keys, row, self.width) + row * self.width])
        return out


def dealt(rows: DataFrame, parts: DataFrame, width: int, key: str, slot: str, least: int) -> DataFrame:
    """The rows, without the column `slot`, whose key is estimated to be there `least` times or more. `slot` is slots(key) for
    this width; rows meet their slot's blocks in one task, behind them."""
    n = width // BLOCK
    kept = [c for c in rows.columns if c != slot]
    marks = merged(parts).select((F.col("block") % n).cast("long").alias("_slot"), F.floor(F.col("block") / n).cast("int").alias("_row"), "places", "counts", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in kept])
    own = rows.select(F.col(slot).alias("_slot"), F.lit(DEPTH).alias("_row"), F.lit(None).cast("binary").alias("places"), F.lit(None).cast("binary").alias("counts"), *kept)
    at = 4 + kept.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, now = np.zeros((DEPTH, BLOCK), np.uint8), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            slot, row = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # a mark stands alone; rows of one slot are looked up together
            new = np.append(True, (slot[1:] != slot[:-1]) | (row[1:] != row[:-1]))
            bounds = np.append(np.flatnonzero(new), batch.num_rows).tolist()
            for a, b in zip(bounds, bounds[1:]):
                if slot[a] != now:
                    table[:], now = 0, slot[a]
                if row[a] < DEPTH:
                    table[row[a]][np.frombuffer(batch.column(2)[a].as_py(), "<u2")] = np.frombuffer(batch.column(3)[a].as_py(), np.uint8)
                else:
                    keys = batch.column(at).slice(a, b - a).to_numpy().view(np.uint64)
                    found = np.minimum.reduce([table[r][inside(keys, r)] for r in range(DEPTH)])
                    part = batch.slice(a, b - a).filter(pa.array(found >= least))
                    yield pa.RecordBatch.from_arrays(part.columns[4:], names=kept)

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in kept)
    return marks.unionByName(own).repartition("_slot").sortWithinPartitions("_slot", "_row").mapInArrow(run, schema)
