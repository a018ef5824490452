"""Structured Streaming counterparts: gap detection, book replay, decayed sums and windowed counts over live tapes. Additions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from propago.operators.book import FEATURE_NAMES, FEATURES, Book, Side, features
from propago.operators.hawkes import excite


def read_tape(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """A tape (seg, seq, t_ns, ...) that grows by files, with ``ts`` for watermarks."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    return stream.withColumn("ts", F.timestamp_micros((F.col("t_ns") / 1000).cast("long")))


def windowed_counts(tape: DataFrame, width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by series, type and aligned window; rows later than the watermark are dropped by Spark."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return tape.withWatermark("ts", late).groupBy("seg", "m", window.alias("w")).agg(F.count(F.lit(1)).alias("n")).select("seg", "m", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_trades(trades: DataFrame, key: str = "trade_id", late: str = "1 hour") -> DataFrame:
    """Trades whose id was not seen within the watermark."""
    return trades.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def sequence_gaps(updates: DataFrame) -> DataFrame:
    """(symbol, capture_seq, expected, found) wherever an update does not follow the last one; one number of state a symbol."""

    def check(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("capture_seq")
        last = state.get[0] if state.exists else None
        out = []
        for seq, first, end in zip(rows["capture_seq"], rows["first_seq"], rows["last_seq"]):
            if last is not None and first != last + 1:
                out.append((*key, seq, last + 1, first))
            last = int(end)
        state.update((last,))
        yield pd.DataFrame(out, columns=["symbol", "capture_seq", "expected", "found"])

    return updates.groupBy("symbol").applyInPandasWithState(check, "symbol long, capture_seq long, expected long, found long", "last long", "append", GroupStateTimeout.NoTimeout)


def decayed_counts(tape: DataFrame, beta, n_exciting: int, unit_ns: int) -> DataFrame:
    """(seg, seq, t_ns, R) as in the batch operator; the state is one vector a series, whatever its length.

    Events must come in order of (t_ns, seq) across batches of a series; within a batch they are sorted.
    """
    beta = np.asarray(beta, float)

    def recur(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tables = list(batches)
        columns = [np.concatenate([x[c].to_numpy() for x in tables]) for c in ("t_ns", "seq", "e")]
        order = np.lexsort((columns[1], columns[0]))
        t, seq, e = (x[order] for x in columns)
        at, flat = state.get if state.exists else (t[0], np.zeros(len(beta) * n_exciting))
        begin = np.array(flat, float).reshape(1, len(beta), n_exciting)
        out, ended = excite(np.array([0]), np.diff(t, prepend=at) / unit_ns, e, beta, begin)
        state.update((int(t[-1]), ended.ravel().tolist()))
        yield pd.DataFrame({"seg": key[0], "seq": seq, "t_ns": t, "R": list(out.reshape(len(t), -1))})

    return tape.groupBy("seg").applyInPandasWithState(recur, "seg long, seq long, t_ns long, R array<double>", "at long, held array<double>", "append", GroupStateTimeout.NoTimeout)


#: The state store that this state needs.
_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Replay(StatefulProcessor):
    """One series' live levels, read and kept once a batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getValueState("levels", "bid array<double>, bids array<double>, ask array<double>, asks array<double>")
        self.seen = handle.getValueState("seen", "last_seq long, gaps long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["update", "pos"])
        last, gaps = self.seen.get() if self.seen.exists() else (None, 0)
        bid, bids, ask, asks = self.levels.get() if self.levels.exists() else ((), (), (), ())
        book = Book(Side(-1, bid, bids), Side(1, ask, asks))
        number, first = np.unique(table["update"].to_numpy(), return_index=True)
        kept, missed = np.zeros(len(number), bool), []
        for k, (begin, end) in enumerate(zip(table["first_seq"].to_numpy()[first].tolist(), table["last_seq"].to_numpy()[first].tolist())):
            if last is not None and end <= last:
                continue
            gaps += last is not None and begin > last + 1
            last, kept[k] = end, True
            missed.append(gaps)
        if missed:
            own = np.repeat(kept, np.diff([*first, len(table)]))
            at = np.repeat(np.arange(len(missed)), np.diff([*first, len(table)])[kept])
            sides = book.fold(at, (table["side"] == "bid").to_numpy()[own], table["price"].to_numpy()[own], table["quantity"].to_numpy()[own])
            self.levels.update(tuple(x.tolist() for side in (book.bid, book.ask) for x in (side.sign * side.price, side.quantity)))
            self.seen.update((last, int(gaps)))
            told = dict(zip(FEATURE_NAMES, (x.to_pandas() for x in features(*sides))))
            yield pd.DataFrame({"symbol": key[0], "update": number[kept], "gaps": missed, **told})

    def close(self) -> None:
        pass


def book_states(levels: DataFrame) -> DataFrame:
    """(symbol, update, gaps, features) after every update of a stream of level rows, as the batch replay gives them.

    Rows are (symbol, update, first_seq, last_seq, pos, side, price, quantity). Updates of a series come in order across
    batches, each whole in one batch; within a batch they are sorted. Updates up to the last sequence number seen are
    stale and go; ``gaps`` counts those that did not follow, so that 0 marks states of an unbroken feed. The state of a
    series is its live levels.
    """
    levels.sparkSession.conf.set(*_STORE)
    return levels.groupBy("symbol").transformWithStateInPandas(_Replay(), f"symbol long, update long, gaps long, {FEATURES}", "Append", "None")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process all that is there and return what was written."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)
