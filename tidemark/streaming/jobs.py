"""Structured Streaming jobs over ticks: bars, sliding statistics, sessions with state, incremental features, sinks.

Every job runs with the availableNow trigger, so it ends when all files are read; the same job with another trigger
runs on. Append mode emits a window once the watermark has passed its end, so windows still open at the end are not
emitted.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.joins import asof_join
from tidemark.session import shared_dir, sized_broadcast

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Ticks that are packed, held and handed on together, at most; a staged file has about so many events at most.
TICKS, STAGED = 1 << 16, 250_000
_KINDS = {"us": np.int64, "tick_id": np.int64, "price": np.float64}


def tick_stream(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """Ticks from the files of the events table, a file or a folder of them; each goes through its message form, JSON with the fields at the root or under `data`."""
    events = spark.readStream.schema(EVENTS).options(**({"maxFilesPerTrigger": files} if files else {})).parquet(f"{sf_dir}/event[s].parquet")  # a pattern: a stream's path may not be a file
    fields = F.struct(F.col("event_type").alias("s"), F.col("value").alias("p"), F.get_json_object("props", "$.k").cast("double").alias("q"))
    message = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(fields.alias("data")))).otherwise(F.to_json(fields))
    parsed = F.from_json(message, "s string, p double, q double, data struct<s: string, p: double, q: double>")
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), parsed.alias("m"))
    pick = lambda c: F.coalesce(F.col(f"m.data.{c}"), F.col(f"m.{c}"))
    return rows.select(pick("s").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), pick("p").alias("price"), pick("q").alias("qty"))


def home(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def run_to_table(stream: DataFrame, name: str) -> DataFrame:
    """The stream's rows, appended to Parquet files of the shared folder until all input is read."""
    spark = stream.sparkSession
    where = home(spark, name)
    started = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")


def run_batches(stream: DataFrame, name: str) -> DataFrame:
    """The same through foreachBatch: each batch overwrites its own folder, so a batch that is run again changes nothing."""
    spark = stream.sparkSession
    where = home(spark, name)

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{where}/rows/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{where}/rows").drop("batch")


def tumbling_bars(ticks: DataFrame, width: str = "2 hours", late: str = "2 minutes") -> DataFrame:
    order = F.struct("ts", "tick_id")
    got = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("n")
    )
    return got.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n")


def sliding_stats(ticks: DataFrame, width: str = "24 hours", step: str = "1 hour", late: str = "2 minutes") -> DataFrame:
    got = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum("qty").alias("volume"), F.max("price").alias("high"))
    return got.select("symbol", F.col("w.start").alias("start"), "n", "volume", "high")


def _as_bytes(frame: pd.DataFrame) -> tuple[bytes, ...]:
    return tuple(frame[c].to_numpy(kind).tobytes() for c, kind in _KINDS.items())


def _as_rows(packs: list[tuple[bytes, ...]]) -> pd.DataFrame:
    return pd.DataFrame({c: np.frombuffer(b"".join(p[i] for p in packs), kind) for i, (c, kind) in enumerate(_KINDS.items())})


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ticks of a task, up to TICKS at once, as a row a symbol: its latest time and the ticks' columns as bytes."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        frame = pa.Table.from_batches(held).to_pandas()
        out = [(None if pd.isna(symbol) else symbol, int(own["us"].max()), *_as_bytes(own)) for symbol, own in frame.groupby("symbol", dropna=False, sort=False)]
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], names=["symbol", "latest", *_KINDS])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held += [batch] if batch.num_rows else []
        if sum(b.num_rows for b in held) >= TICKS:
            yield pack(held)
            held = []
    if held:
        yield pack(held)


class InOrder(StatefulProcessor):
    """Holds a key's rows until the watermark has passed them, then hands them on in the order of time and tick.

    Rows may come in any order and over any number of batches, as long as none is later than the watermark (those are
    dropped). They come and are held packed: a row of state for TICKS of them, since a row each costs a message each.
    A timer at the first held row's time wakes a key that gets no more rows. What a batch hands on comes to `step` in
    sorted frames of at most TICKS rows; it keeps what it needs for the next one in state. A key's rows of a batch meet
    in one task, as 24 bytes each, so what a batch may hold (files or bytes a trigger) bounds its memory, with the rows
    of the time that ticks may be late.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "us binary, tick_id binary, price binary")
        self.opened(handle)

    def opened(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [_as_rows(list(frame[[*_KINDS]].itertuples(index=False))) if frame["us"].dtype == object else frame[[*_KINDS]].astype(_KINDS) for frame in rows]
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        yield from self._pass_on(key, [frame[frame["us"] > mark] for frame in fresh], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._pass_on(key, [], timerValues)

    def _pass_on(self, key: tuple, fresh: list[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            fresh = [_as_rows(list(self.held.get())), *fresh]
        if not fresh:
            return
        frame = pd.concat(fresh).sort_values([*_KINDS][:2], kind="stable")
        done = (frame["us"] <= timers.getCurrentWatermarkInMs() * 1000).to_numpy()
        ready, rest = frame[done], frame[~done]
        if len(rest):
            self.held.put([_as_bytes(rest[k : k + TICKS]) for k in range(0, len(rest), TICKS)])
        else:
            self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if len(rest):
            self.handle.registerTimer(int(rest["us"].iloc[0]) // 1000)
        for k in range(0, len(ready), TICKS):
            yield self.step(key, ready[k : k + TICKS].reset_index(drop=True))

    def close(self) -> None:
        pass


class Sessions(InOrder):
    """On from a price of `on` until one below `off`: emits each session when it ends, with its ticks.

    A session of fewer than `least` ticks is none; one of more than `most` ends with the first tick beyond them, and
    the next begins only after the price has been below `off`.
    """

    def __init__(self, on: float, off: float, least: int = 0, most: int | None = None):
        self.on, self.off, self.least, self.most = on, off, least, most

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getValueState("open", "start long, n int, ended boolean")

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        start, n, ended = self.open.get() if self.open.exists() else (-1, 0, False)
        us, price = rows["us"].to_numpy(), rows["price"].to_numpy()
        event = np.where(price >= self.on, 1, np.where(price < self.off, 0, -1))
        last = np.maximum.accumulate(np.where(event >= 0, np.arange(len(event)), -1))
        state = np.where(last >= 0, event[np.maximum(last, 0)], int(start >= 0))
        before = np.concatenate(([int(start >= 0)], state[:-1]))
        begins = [*([-1] if start >= 0 else []), *np.flatnonzero(state > before).tolist()]
        ends = np.flatnonzero(state < before).tolist()
        out = []
        for k, begin in enumerate(begins):
            if begin >= 0:
                start, n, ended = int(us[begin]), 0, False
            first = max(begin, 0)
            end = ends[k] if k < len(ends) else len(us)
            if self.most is not None and not ended and n + end - first > self.most:
                out.append((key[0], start, int(us[first + self.most - n]), self.most))
                ended = True
            n += end - first
            if k < len(ends):
                if not ended and n >= self.least:
                    out.append((key[0], start, int(us[end]), n))
                start = -1
        self.open.update((start, int(n), ended) if start >= 0 else (-1, 0, False))
        return pd.DataFrame(out, columns=["symbol", "start_us", "end_us", "n"]).astype({"start_us": "int64", "end_us": "int64", "n": "int32"})


class RollingFeatures(InOrder):
    """Exponential average, carried as one number, and mean and population deviation of the last `size` prices, carried as a ring of that many."""

    def __init__(self, alpha: float, size: int):
        self.alpha, self.size = alpha, size

    def opened(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")
        self.ring = handle.getListState("ring", "price double")

    def step(self, key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        price = rows["price"].to_numpy()
        carried = [self.last.get()[0]] if self.last.exists() else []
        ema = pd.Series([*carried, *price]).ewm(alpha=self.alpha, adjust=False).mean().to_numpy()[len(carried) :]
        ring = np.array([r[0] for r in self.ring.get()] if self.ring.exists() else [])
        series = np.concatenate((ring, price))
        padded = np.concatenate((np.full(self.size - 1, np.nan), series))
        windows = np.lib.stride_tricks.sliding_window_view(padded, self.size)[len(ring) :]
        self.last.update((float(ema[-1]),))
        self.ring.put([(float(p),) for p in series[-self.size :]])
        return pd.DataFrame({"symbol": key[0], "tick_id": rows["tick_id"], "ema": ema, "mean": np.nanmean(windows, axis=1), "deviation": np.nanstd(windows, axis=1)})


def with_state(ticks: DataFrame, processor: InOrder, schema: str, late: str = "2 minutes") -> DataFrame:
    """A stateful operator per symbol on event time, on the RocksDB state store; ticks may be so late. Ticks without time or price are left out."""
    ticks.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = ticks.where("price is not null and ts is not null").select("symbol", F.unix_micros("ts").alias("us"), "tick_id", "price")
    rows = rows.mapInArrow(packed, "symbol string, latest long, us binary, tick_id binary, price binary").withColumn("ts", F.timestamp_micros("latest")).withWatermark("ts", late)
    return rows.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")


def staged_files(spark: SparkSession, sf_dir: str, delay_seconds: Column, files: int = 6) -> str:
    """A folder with an events table that arrived in so many files, one after another: by an event's time and its delay, in equal spans of time.

    Where spans hold many events, each is as many Parquet files as any other (`staged_stream` reads them together).
    """
    where = home(spark, "staged")
    events = spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet").withColumn("_at", F.unix_micros(F.col("ts").cast("timestamp")))
    first, last, n = events.agg(F.min("_at"), F.max("_at"), F.count("*")).first()
    parts = max(1, -(-n // (files * STAGED)))
    span = ((last or 0) - (first or 0)) // files + 1
    number = F.least(F.lit(files - 1), F.floor((F.col("_at") + delay_seconds.cast("long") * 1_000_000 - (first or 0)) / span))
    arrived = events.withColumn("_file", number)
    for k in range(files):  # one write each, so that a stream reads them in this order
        own = arrived.where(F.col("_file") == k).drop("_at", "_file")
        own.repartition(parts, "event_id").write.mode("append").parquet(f"{where}/events.parquet")
        for _ in range((k + 1) * parts - staged_count(spark, where)):  # an empty task writes no file
            own.limit(0).coalesce(1).write.mode("append").parquet(f"{where}/events.parquet")
    return where


def staged_count(spark: SparkSession, where: str) -> int:
    """How many Parquet files a staged events table has."""
    return len(spark.read.schema(EVENTS).parquet(f"{where}/events.parquet").inputFiles())


def staged_stream(spark: SparkSession, sf_dir: str, delay_seconds: Column, files: int = 6) -> DataFrame:
    """Ticks in the order of arrival: each of so many spans of time is a batch, whatever its size."""
    where = staged_files(spark, sf_dir, delay_seconds, files)
    return tick_stream(spark, where, files=staged_count(spark, where) // files)


def split_late(ticks: DataFrame, name: str, late: str = "2 minutes", width: str = "2 hours") -> tuple[DataFrame, DataFrame]:
    """Runs the stream and gives two tables that share its ticks: those in time for their window, and those whose window the watermark had closed.

    The watermark of a batch is the latest time of all batches before it less `late`; it is kept beside the ticks for
    each batch, and a batch that is run again writes the same rows over its own folder.
    """
    spark = ticks.sparkSession
    where = home(spark, name)
    seen = "batch long, latest timestamp"

    def write(rows: DataFrame, batch: int) -> None:
        marks = spark.createDataFrame([], seen) if batch == 0 else spark.read.schema(seen).parquet(f"{where}/marks/*")
        mark = marks.where(F.col("batch") < batch).agg((F.max("latest") - F.expr(f"interval {late}")).alias("_mark"))
        closed = F.window("ts", width)["end"] <= F.col("_mark")
        rows.join(F.broadcast(mark)).withColumn("late", F.coalesce(closed, F.lit(False))).drop("_mark").write.mode("overwrite").partitionBy("late").parquet(f"{where}/ticks/batch={batch}")
        mine = spark.read.schema(rows.schema).parquet(f"{where}/ticks/batch={batch}")
        mine.agg(F.lit(batch).cast("long").alias("batch"), F.max("ts").alias("latest")).write.mode("overwrite").parquet(f"{where}/marks/{batch}")

    ticks.writeStream.foreachBatch(write).option("checkpointLocation", f"{where}/progress").trigger(availableNow=True).start().awaitTermination()
    table = spark.read.schema(f"{ticks._jdf.schema().toDDL()}, batch long, late boolean").parquet(f"{where}/ticks").drop("batch")
    return table.where("not late").drop("late"), table.where("late").drop("late")


def repaired_bars(bars: DataFrame, in_time: DataFrame, late: DataFrame, width: str = "2 hours") -> DataFrame:
    """Bars of ticks that came in time, those that late ticks belong to being built again from all their ticks.

    Only ticks of such bars are read again: by broadcast of the bars' names where these are few, else by shuffle.
    """
    named = lambda df: df.withColumn("_start", F.window("ts", width)["start"])
    touched = sized_broadcast(named(late).select("symbol", "_start").distinct())
    kept = bars.join(touched, (bars["symbol"] == touched["symbol"]) & (bars["ts"] == touched["_start"]), "left_anti")
    ticks = named(in_time.unionByName(late))
    again = tumbling_bars(ticks.join(touched, ["symbol", "_start"], "left_semi").drop("_start"), width)
    return kept.unionByName(again.select(*bars.columns))


def gaps(bars: DataFrame, hours: int = 2) -> DataFrame:
    """Times between a symbol's first and last bar at which it has none."""
    span = bars.groupBy("symbol").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    due = span.select("symbol", F.explode(F.sequence("a", "z", F.expr(f"interval {hours} hours"))).alias("ts"))
    return due.join(bars.select("symbol", "ts"), ["symbol", "ts"], "left_anti")


def backfill(bars: DataFrame, hours: int = 2) -> DataFrame:
    """Bars and, at the gaps, bars without volume at the close before."""
    known = bars.select("symbol", "ts", "close", "volume")
    missing = asof_join(gaps(bars, hours), known.select("symbol", "ts", "close"), "symbol", "ts", ["close"], slot_seconds=86_400)
    return known.unionByName(missing.withColumn("volume", F.lit(0.0)))


def deduplicated(ticks: DataFrame, within: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", within).dropDuplicatesWithinWatermark(["tick_id"])
