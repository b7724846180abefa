"""Filters on streams: fitted projections as they are, and a shift that keeps each series' last rows as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from ..operators.columns import Fitted


def transform_stream(stream: DataFrame, fitted: Fitted) -> DataFrame:
    return fitted.transform(stream)


def delta_stream(stream: DataFrame, key: str, order: str, value: str, lag: int = 1) -> DataFrame:
    """(key, order, delta): value less that of ``lag`` rows before in its series, null for the first rows.

    A series' last ``lag`` values are its state, so memory doesn't grow with the stream.
    """

    def step(name: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        values = [*([None] * (lag - len(last))), *last, *rows[value].tolist()]
        rows["delta"] = [None if a is None or pd.isna(a) or pd.isna(b) else b - a for a, b in zip(values, values[lag:], strict=False)]
        state.update((values[-lag:],))
        yield rows.assign(**{key: name[0]})[[key, order, "delta"]]

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, delta double", "last array<double>", "append", "NoTimeout")
