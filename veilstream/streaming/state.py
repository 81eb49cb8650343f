"""Folds over the chunks of streams whose state ends: with the stream, or when nothing has come for a while."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: seconds without a chunk after which a stream counts as broken off
IDLE_SECONDS = 300
#: rows that a task of the batch form hands on at a time
_ROWS = 1024
_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def keep_state(spark: SparkSession) -> None:
    """Timers need the state store that has them; queries that run already, or restart, keep to their own."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class Fold:
    """A stream's state is a row (see ``state``), its output rows are of the columns behind stream_id in ``output``."""

    state: str
    output: str

    def begin(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, chunk_no: int, chunk: bytes, last: bool) -> tuple[list[tuple], tuple]:
        raise NotImplementedError

    def broken_off(self, state: tuple) -> list[tuple]:
        """What a stream that ended without its last chunk still gives."""
        raise NotImplementedError


class _Chunks(StatefulProcessor):
    def __init__(self, fold: Fold, idle_seconds: float):
        self.fold, self.idle = fold, max(1, round(idle_seconds * 1000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.fold.state)

    def _rows(self, key, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        names = ["stream_id", *(x.split()[0] for x in self.fold.output.split(", "))]
        if rows:
            yield pd.DataFrame([(key[0], *r) for r in rows], columns=names, dtype=object)

    def _no_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else self.fold.begin()
        out, ended = [], False
        for pdf in rows:
            pdf = pdf.sort_values("chunk_no")
            for no, chunk, last in zip(pdf["chunk_no"].tolist(), pdf["bytes"], pdf["last"].tolist(), strict=True):
                more, state = self.fold.step(state, no, bytes(chunk), last)
                out += more
                ended |= last
        self._no_timers()
        if ended:
            self.held.clear()
        else:
            self.held.update(state)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield from self._rows(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = tuple(self.held.get()) if self.held.exists() else None
        self.held.clear()
        yield from self._rows(key, self.fold.broken_off(state) if state is not None else [])

    def close(self) -> None:
        pass


def folded(chunks: DataFrame, fold: Fold, idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """Streaming: chunks (stream_id, chunk_no, bytes, last), each stream's in order, through the fold."""
    keep_state(chunks.sparkSession)
    return chunks.select("stream_id", "chunk_no", "bytes", "last").groupBy("stream_id").transformWithStateInPandas(_Chunks(fold, idle_seconds), f"stream_id string, {fold.output}", "append", "ProcessingTime")


def folded_table(chunks: DataFrame, fold: Fold) -> DataFrame:
    """Batch: chunks (stream_id, chunk_no, bytes) through the fold; the last of a stream's chunks ends it.

    Streams come one after the other in their task's rows, so that short ones cost no more than their chunks, and of
    long ones only the state is held.
    """
    output = f"stream_id string, {fold.output}"
    names, kinds = zip(*((n, _KINDS[k]) for n, k in (x.split() for x in output.split(", "))), strict=True)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, out = None, fold.begin(), []
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("stream_id", "chunk_no", "bytes")), strict=True):
                if held is not None:
                    last = row[0] != held[0]
                    more, state = fold.step(state, held[1], held[2], last)
                    out += [(held[0], *r) for r in more]
                    if last:
                        state = fold.begin()
                    if len(out) >= _ROWS:
                        yield batch_of(out)
                        out = []
                held = row
        if held is not None:
            out += [(held[0], *r) for r in fold.step(state, held[1], held[2], True)[0]]
        if out:
            yield batch_of(out)

    rows = chunks.select(F.col("stream_id").cast("string").alias("stream_id"), F.col("chunk_no").cast("long").alias("chunk_no"), "bytes")
    parts = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # said, as tasks dealt by bytes would be few: chunks are small for their work
    return rows.repartition(parts, "stream_id").sortWithinPartitions("stream_id", "chunk_no").mapInArrow(run, output)
