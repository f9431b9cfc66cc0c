"""Small helpers for functions over groups of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.scratch import map_batches


def over_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """Applies ``fn`` to the rows of each value of the integer ``keys``; many small groups share a task and its batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                this = key[lo].tobytes()
                if held and this != last:
                    yield from give(held)
                    held = []
                last = this
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from give(held)

    def give(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = fn(pa.Table.from_batches(held).combine_chunks())
        if out is not None and out.num_rows:
            yield from out.to_batches()

    return map_batches(df.repartition(*keys).sortWithinPartitions(*keys), run, schema)
