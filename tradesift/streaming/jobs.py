"""The jobs as Structured Streaming: landed items in micro-batches, the same batch functions inside ``foreachBatch``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tradesift import schemas
from tradesift.config import DEFAULT, Config
from tradesift.operators import classify, dedup, numbering, state
from tradesift.plans import pipeline


def landed(items: DataFrame) -> DataFrame:
    """Items of files with what ``in_arrival_order`` needs."""
    return items.select("*", F.struct("_metadata.file_modification_time", "_metadata.file_path", "_metadata.file_block_start").alias("_file"))


def in_arrival_order(items: DataFrame) -> DataFrame:
    """A batch of landed items, as read, with seq: dense numbers by the time their file landed, its name, and their place
    in it."""
    placed = items.withColumn("_row", F.monotonically_increasing_id())
    return numbering.numbered(placed, [F.col("_file"), F.col("_row")], dedup.cut, "seq").drop("_file", "_row")


def news_stream(
    spark: SparkSession,
    landing: str,
    store: state.StateStore,
    model: classify.Classifier,
    checkpoint: str,
    sink: pipeline.Sink | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    config: Config = DEFAULT,
    notify: pipeline.Notify | None = None,
) -> StreamingQuery:
    """New files of JSON items go through the news job, batch by batch; offsets live in the checkpoint. A batch that the
    sink refuses fails, so it is run again with the next start."""
    items = landed(spark.readStream.schema(schemas.ITEM).json(landing))

    def batch(df: DataFrame, epoch: int) -> None:
        if not df.isEmpty():
            done = pipeline.run_news(in_arrival_order(df), store, model, clock(), sink, config=config, notify=notify)
            if not done.sent:
                raise RuntimeError(f"batch {epoch}: the sink did not take the alerts")

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Keeps state on disk beside memory, so it is bounded by neither, and writes only what a batch changes.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_seen(source: DataFrame, key: str, order: tuple[str, ...], days: int | None = None) -> DataFrame:
    """As a stream: of each key that no earlier batch has brought the first row in ``order`` (nulls first). Null and empty
    keys go. The state holds one flag a key, so a batch costs what it brings, however long the history; after ``days``
    without a row, if given, a key is forgotten."""

    columns = source.columns

    def step(name: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        best = None
        if not held.exists:  # frames of a key come in pieces, of which the least row is kept
            for frame in frames:
                best = pd.concat([frame] if best is None else [best, frame]).sort_values(list(order), na_position="first", kind="stable").head(1)
        held.update((True,))
        if days is not None:
            held.setTimeoutDuration(days * 86_400_000)
        if best is not None:
            yield best[columns]

    kept = source.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "")
    timeout = GroupStateTimeout.NoTimeout if days is None else GroupStateTimeout.ProcessingTimeTimeout
    return kept.groupBy(key).applyInPandasWithState(step, source.schema, "seen boolean", "append", timeout)


def dedup_stream(source: DataFrame, key: str, order: tuple[str, ...], out: str, checkpoint: str, days: int | None = None) -> StreamingQuery:
    """First row of each key over all batches, appended to ``out`` once each, though a batch may be repeated. What was
    written before is never read: keys live in the state store."""
    spark = source.sparkSession
    name, provider = STATE_STORE
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:  # a query keeps the settings it was started with
        return first_seen(source, key, order, days).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def windowed_counts(events: DataFrame, at: str, late: str, width: str, key: str, value: str) -> DataFrame:
    """Event-time sums by key and tumbling window; late rows beyond the watermark are dropped by the engine."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def pattern_stream(sales: DataFrame, late: str, days: int, least: float, min_n: int, max_share: float, multiple: float) -> DataFrame:
    """Event-time mode of the split-up pattern: state is the sales of the last ``days`` and the last alerted total per
    (person, company). Columns person_key, company_key, at, value_cr."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        times, values, last = held.get if held.exists else ([], [], -1.0)
        times, values, out = list(times), list(values), []
        rows = pd.concat(list(frames)).sort_values("at")
        for at, value in zip(rows["at"], rows["value_cr"]):
            ms = int(at.timestamp() * 1000)
            times.append(ms)
            values.append(float(value))
            live = [(t, v) for t, v in sorted(zip(times, values)) if t >= ms - days * 86_400_000]
            times, values = [t for t, _ in live], [v for _, v in live]
            total = round(sum(v for t, v in live if t <= ms), 2)
            if total >= least and len(live) >= min_n and max(values) <= max_share * total and (last < 0 or total >= multiple * last):
                out.append((*key, at, total, len(live)))
                last = total
        held.update((times, values, last))
        if out:
            yield pd.DataFrame(out, columns=["person_key", "company_key", "at", "total_cr", "n"])

    return (
        sales.withWatermark("at", late)
        .groupBy("person_key", "company_key")
        .applyInPandasWithState(step, "person_key string, company_key string, at timestamp, total_cr double, n int", "times array<long>, amounts array<double>, last double", "append", GroupStateTimeout.NoTimeout)
    )


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder that driver and executors share."""
    import uuid

    return f"{dedup.shared_folder(spark)}/tradesift/{what}-{uuid.uuid4().hex}"
