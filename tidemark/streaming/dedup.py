"""Exactly-once application of command streams.

Deduplication keeps, for each client, the last request number applied; a command
counts only above it. State lives in the state store; commands of one micro-batch
are taken in index order. Application appends what counts to a table, one commit
for each micro-batch: a batch that is replayed after a failure finds its number
committed and does nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.files import Files

OUT = "idx long, client_id string, request_seq long, key string, value string, operation string"


def _only_new(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    rows = pd.concat(list(frames)).sort_values("idx")
    if rows.empty:
        return
    top = rows["request_seq"].cummax().shift()
    if last is not None:
        top = top.fillna(last).clip(lower=last)
    new = rows[top.isna() | (rows["request_seq"] > top)]
    best = int(rows["request_seq"].max())
    state.update((best if last is None else max(best, last),))
    yield new[["idx", "client_id", "request_seq", "key", "value", "operation"]]


def applied_stream(commands: DataFrame) -> DataFrame:
    """The streaming counterpart of ``commands.applied``. Within a micro-batch one client's commands are sorted in
    memory, so the trigger's limits bound it."""
    cols = commands.select("idx", "client_id", "request_seq", "key", "value", "operation")
    return cols.groupBy("client_id").applyInPandasWithState(_only_new, OUT, "last long", "append", GroupStateTimeout.NoTimeout)


class BatchSink:
    """A ``foreachBatch`` sink: each micro-batch is a folder of Parquet, committed by a small file of its number."""

    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")

    def __call__(self, batch: DataFrame, number: int) -> None:
        files = Files(batch.sparkSession, self.path)
        files.mkdirs()
        mark = f"commit-{number:012d}.json"
        if mark in files.names():
            return
        batch.write.mode("overwrite").parquet(f"{self.path}/batch-{number:012d}.parquet")
        files.write_new(mark, json.dumps({"batch": number}).encode())

    def read(self, spark) -> DataFrame | None:
        """The committed batches."""
        done = [n[len("commit-") : -len(".json")] for n in Files(spark, self.path).names() if n.startswith("commit-")]
        paths = [f"{self.path}/batch-{n}.parquet" for n in done]
        return spark.read.parquet(*paths) if paths else None
