"""Best-reference state over a stream of rollouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "accuracy double, value double, step long"
OUT = "key long, accuracy double, value double, step long"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BestReference(StatefulProcessor):
    """Keeps the greatest (accuracy, value) of a key; of equals the one with the least step. It only grows."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        best = self.best.get() if self.best.exists() else None
        before = best = None if best is None else (float(best[0]), float(best[1]), -int(best[2]))
        for pdf in rows:
            for a, v, s in zip(pdf["accuracy"], pdf["value"], pdf["step"]):
                if pd.notna(a) and pd.notna(v):
                    best = max(best or (float("-inf"),) * 3, (float(a), float(v), -int(s)))
        if best is not None and best != before:
            self.best.update((best[0], best[1], -best[2]))
        if best is not None:
            yield pd.DataFrame({"key": [key[0]], "accuracy": [best[0]], "value": [best[1]], "step": [-best[2]]})

    def close(self) -> None:
        pass


def best_stream(rollouts: DataFrame) -> DataFrame:
    """Stream of the best reference of each key that a micro-batch touches, for rollouts(key, accuracy, value, step)."""
    rollouts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rollouts.groupBy("key").transformWithStateInPandas(BestReference(), OUT, "Update", "None")
