"""Run a fold per key: over a batch table, or over a stream with its state kept by Spark.

Batch rows are partitioned by key and sorted by Spark (which spills), then folded as they stream by: a task holds one
batch of rows and one state, however many rows a key has. A stream's micro-batches are ordered within themselves.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from loomline.streaming.folds import Fold


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def fold_batch(rows: DataFrame, key: str, order: str, fold: Fold, out: str) -> DataFrame:
    """(key, order, outputs): ``out`` is the schema of the outputs."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), dict(fold.start)
        for pdf in frames:
            found = []
            for row in pdf.to_dict("records"):
                if row[key] != now:
                    now, state = row[key], dict(fold.start)
                state, outputs = fold.step(state, row)
                found += [{key: now, order: row[order], **o} for o in outputs]
            yield pd.DataFrame(found, columns=[key, order, *_columns(out)])

    ordered = rows.repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInPandas(run, f"{key} long, {order} long, {out}")


def fold_stream(rows: DataFrame, key: str, order: str, fold: Fold, out: str) -> DataFrame:
    """The same over a stream; the state is one JSON string per key."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = json.loads(held.get[0]) if held.exists else dict(fold.start)
        found = []
        for row in pd.concat(list(frames)).sort_values(order).to_dict("records"):
            state, outputs = fold.step(state, row)
            found += [{key: row[key], order: row[order], **o} for o in outputs]
        held.update((json.dumps(state),))
        yield pd.DataFrame(found, columns=[key, order, *_columns(out)])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} long, {order} long, {out}", "state string", "append", "NoTimeout")
