"""Carrying the last observation forward over a stream.

The state of a group is the last observed value of each column: a few numbers,
whatever the stream's length.  Rows of a micro-batch are carried in their order;
a row older than one already seen is filled from the state as it then is.  A hole
before a group's first observation stays missing, since the future is not known.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_locf(df: DataFrame, columns: Sequence[str], groups: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """``df`` (a stream) with holes of numeric ``columns`` filled by the group's last observation."""
    cols, names = list(columns), list(df.columns)
    state_schema = T.StructType([T.StructField(c, T.DoubleType()) for c in cols])
    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name in cols else f.dataType) for f in df.schema])

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get) if state.exists else [None] * len(cols)
        rows = pd.concat(list(batches)).sort_values(list(order_by), kind="stable")
        for i, c in enumerate(cols):
            filled = rows[c].astype(float).ffill()
            if last[i] is not None:
                filled = filled.fillna(last[i])
            rows[c] = filled
            if filled.notna().any():
                last[i] = float(filled.dropna().iloc[-1])
        state.update(tuple(last))
        yield rows[names]

    return df.groupBy(*groups).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)
