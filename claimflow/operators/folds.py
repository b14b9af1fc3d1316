"""Rows of a key taken in order by a small state, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame


def fold_in_order(rows: DataFrame, keys: list[str], order: list[str], begin: Callable[[], Any], step: Callable[[Any, Any], tuple], schema: str) -> DataFrame:
    """For each row ``step(state, row)``, a row of ``schema``, with a new ``begin()`` for each key.

    Spark shuffles by ``keys`` and sorts by keys and ``order``, spilling as it must; a task then reads its rows as a stream of
    Arrow batches and holds one batch and one state, however many rows a key has. Null keys are one key.
    """
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                key = tuple(None if pd.isna(v) else v for v in (getattr(row, k) for k in keys))
                if key != last:
                    last, state = key, begin()
                out.append(step(state, row))
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
