"""Structured Streaming forms of ingestion, running profiles and windowed rates."""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, key: str, at: str, delay: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """New files append; rows whose key came within the watermark are dropped, and rows behind the watermark
    too: ``late_rows`` counts these. The sink gets each micro-batch with its number, so it can be idempotent."""
    deduped = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return deduped.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def late_rows(query: StreamingQuery) -> int:
    """How many rows of the batches so far came behind the watermark and were dropped."""
    return sum(op.numRowsDroppedByWatermark for batch in query.recentProgress for op in batch.stateOperators)


def behavior_rates(stream: DataFrame, at: str, player: str, flags: dict, *, window: str = "1 day", slide: str | None = None, session_gap: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Rates per player and window (tumbling, sliding or session), for append mode."""
    span = F.session_window(at, session_gap) if session_gap else F.window(at, window, slide or window)
    rates = [F.avg(c.cast("double")).alias(name) for name, c in flags.items()]
    grouped = stream.withWatermark(at, delay).groupBy(span.alias("span"), player).agg(F.count("*").alias("n"), *rates)
    return grouped.select(F.col("span.start").alias("start"), F.col("span.end").alias("end"), player, "n", *flags)


def player_profile(stream: DataFrame, *, player: str, at: str, row_id: str, flag: str, strength: float = 20.0) -> DataFrame:
    """Each row with its player's smoothed rate of ``flag`` over strictly earlier rows, and their number.

    State per player is two counters. Within a micro-batch rows are put in (time, id) order; what a
    task holds is one player's rows of one micro-batch, which maxFilesPerTrigger bounds.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, hits = state.get if state.exists else (0, 0)
        rows = pd.concat(list(batches)).sort_values([at, row_id], kind="stable")
        flags = rows[flag].astype("int64")
        before = flags.cumsum() - flags + hits
        count = pd.RangeIndex(seen, seen + len(rows))
        state.update((int(seen + len(rows)), int(hits + flags.sum())))
        yield pd.DataFrame({player: key[0], row_id: rows[row_id].to_numpy(), "observations": count.to_numpy(), "rate": ((before + strength * 0.5).to_numpy() / (count.to_numpy() + strength))})

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}
    return stream.groupBy(player).applyInPandasWithState(
        step, f"{player} {kinds[player]}, {row_id} {kinds[row_id]}, observations bigint, rate double", "seen bigint, hits bigint", "append", GroupStateTimeout.NoTimeout
    )


class Tendencies(StatefulProcessor):
    """Running choices of one player, in the order of event time whatever the order of arrival.

    Rows wait in a map by event time and by the batch of Arrow in which they came, so that neither what is read
    nor what is written at once grows with a player's rows. A timer for each time fires once the watermark has
    passed it; the rows of that time are then put in order, encoded one after another by the counts before
    them, and forgotten. Counts are a map by attribute and value.
    """

    AT_ONCE = 10_000

    def __init__(self, names: dict, values: dict[str, list[str]], flags: tuple[str, ...], order: tuple[str, ...], strength: float):
        self.names, self.values, self.flags, self.order, self.strength = names, values, flags, order, strength
        self.held = [names["row_id"], *order, *values, *flags]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batches = handle.getMapState("batches", "at bigint", "n int")
        self.waiting = handle.getMapState("waiting", "at bigint, batch int", "rows string")
        self.counts = handle.getMapState("counts", "what string", "n bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for frame in rows:
            fresh: dict[int, list] = defaultdict(list)
            at = frame[self.names["at"]].dt.floor("ms").astype("datetime64[ms]").astype("int64")
            kept = frame.loc[at > passed, self.held].astype(object)
            for ms, row in zip(at[at > passed].tolist(), kept.itertuples(index=False), strict=True):
                fresh[ms].append([x.item() if hasattr(x, "item") else x for x in row])
            for ms, more in fresh.items():
                batch = self.batches.getValue((ms,))[0] if self.batches.containsKey((ms,)) else 0
                if batch == 0:
                    self.handle.registerTimer(ms)
                self.waiting.updateValue((ms, batch), (json.dumps(more),))
                self.batches.updateValue((ms,), (batch + 1,))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k[0] for k in self.batches.keys() if k[0] <= upto)
        if not due:
            return
        counts = defaultdict(int, {k[0]: v[0] for k, v in self.counts.iterator()})
        changed: set[str] = set()
        for ms in due:
            rows = []
            for batch in range(self.batches.getValue((ms,))[0]):
                rows += [dict(zip(self.held, row, strict=True)) for row in json.loads(self.waiting.getValue((ms, batch))[0])]
                self.waiting.removeKey((ms, batch))
            self.batches.removeKey((ms,))
            rows.sort(key=lambda r: [r[c] for c in self.order])
            for begin in range(0, len(rows), self.AT_ONCE):
                yield pd.DataFrame([self._encoded(key, row, counts, changed) for row in rows[begin : begin + self.AT_ONCE]])
        for what in changed:
            self.counts.updateValue((what,), (counts[what],))

    def _encoded(self, key, row: dict, counts: dict[str, int], changed: set[str]) -> dict:
        total, strength = counts["all"], self.strength
        out = {self.names["player"]: key[0], self.names["row_id"]: row[self.names["row_id"]], "observations": total}
        for name, values in self.values.items():
            out[f"{name}_probability"] = (counts[f"{name}:{row[name]}"] + strength / len(values)) / (total + strength)
        for flag in self.flags:
            p = (counts[flag] + strength * 0.5) / (total + strength)
            out[f"{flag}_match"] = p if row[flag] else 1 - p
        for what in ["all", *(f"{name}:{row[name]}" for name in self.values), *(f for f in self.flags if row[f])]:
            counts[what] += 1
            changed.add(what)
        return out

    def close(self) -> None:
        pass


def player_tendencies(
    stream: DataFrame, *, player: str, at: str, row_id: str, order: tuple[str, ...], values: dict[str, list[str]], flags: tuple[str, ...], delay: str, strength: float = 20.0
) -> DataFrame:
    """Each chosen row with its player's smoothed rates over strictly earlier choices: ``tendencies`` of the batch
    engine in all columns, if rows come no later than ``delay``.

    A row comes out when the watermark passes its time; rows of one time are ordered by ``order``. Rows
    behind the watermark are dropped, and ``late_rows`` counts them. State needs the RocksDB store. What a
    task holds is the rows of one player and time, and a player's counts.
    """
    stream = stream.withWatermark(at, delay).select(player, at, row_id, *[c for c in order if c not in (player, at, row_id)], *values, *[F.col(f).cast(BooleanType()).alias(f) for f in flags])
    kinds = {f.name: f.dataType for f in stream.schema}
    rates = [f"{v}_probability" for v in values] + [f"{f}_match" for f in flags]
    out = StructType([StructField(player, kinds[player]), StructField(row_id, kinds[row_id]), StructField("observations", LongType()), *[StructField(r, DoubleType()) for r in rates]])
    processor = Tendencies({"player": player, "at": at, "row_id": row_id}, values, flags, order, strength)
    return stream.groupBy(player).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="Append", timeMode="EventTime")
