"""Whole groups from key-sorted partitions, without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


def runs(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables that end where a group ends; rows come sorted by the first `keys` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = batch.num_rows
        last = [batch.column(k)[batch.num_rows - 1] for k in range(keys)]
        same = None
        for k in range(keys):
            eq = pc.equal(batch.column(k), last[k])
            same = eq if same is None else pc.and_(same, eq)
        cut = pc.index(same, True).as_py()
        if cut == 0 and held and all(held[-1].column(k)[held[-1].num_rows - 1] == last[k] for k in range(keys)):
            held.append(batch)
            continue
        head = [*held, batch.slice(0, cut)]
        table = pa.Table.from_batches(head)
        if table.num_rows:
            yield table
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def map_groups(df: DataFrame, keys: list[str], f: Callable[[pa.Table], pa.RecordBatch], schema: str, within: str | None = None) -> DataFrame:
    """Calls f on tables of whole groups (`keys` must be the first columns); groups of one key are never split.

    With `within`, the first of the keys, groups are those of this key alone, and the others sort its rows.
    """
    n = 1 if within else len(keys)
    return df.repartition(*([within] if within else keys)).sortWithinPartitions(*keys).mapInArrow(lambda it: map(f, runs(it, n)), schema)
