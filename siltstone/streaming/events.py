"""Streams of analyses and feedback: idempotent ingest, counters, limits, online statistics, last states.

Sources are file streams. Results are kept in the shared folder: each micro-batch appends its updated rows, and the
last row of a key is its state, so nothing is collected and a restart goes on from the checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.graph import shared_dir

DELAY = "1 day"


def shared_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, folder: str, table: str = "events", files_per_batch: int | None = None) -> DataFrame:
    """A file stream of a table, with the table's own schema."""
    schema = spark.read.parquet(f"{folder}/{table}.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    stream = reader.parquet(f"{folder}/{table}.parque[t]")
    return stream.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in stream.columns else stream


def run_updates(stream: DataFrame, keys: list[str], folder: str | None = None, mode: str = "update") -> DataFrame:
    """Runs the stream over what is there and returns the last row of each key."""
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    out = f"{folder}/rows"

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    q = stream.writeStream.outputMode(mode).foreachBatch(append).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.schema(spark.createDataFrame([], stream.schema).withColumn("_batch", F.lit(0)).schema).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    if not rest:
        return rows.select(*keys).distinct()
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_of_each(events: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """Duplicates of a key within the delay are dropped."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys).select(*keys)


def windowed_counts(events: DataFrame, by: list[str], width: str, delay: str = DELAY) -> DataFrame:
    """Builds and failures per tumbling window."""
    g = events.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("failed")).select(F.col("w.start").alias("start"), *by, "n", "failed")


def online_rates(events: DataFrame, by: list[str], is_fp, is_tp) -> DataFrame:
    """False and true positives of each group so far."""
    return events.groupBy(*by).agg(F.count_if(is_fp).alias("fp"), F.count_if(is_tp).alias("tp"))


def last_state(events: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The newest snapshot of each key."""
    return events.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct("ts", "event_id")).alias("s")).select(key, *(F.col(f"s.{c}").alias(c) for c in columns))


def ingest(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str | None = None) -> None:
    """Every micro-batch goes to ``handle``: summaries, issue upserts, rollups."""
    folder = folder or shared_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def batches_of(spark: SparkSession, folder: str, name: str) -> list[int]:
    """Numbers of the finished tables ``name-N`` of a folder, which is the only memory between batches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(path):
        return []
    found = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(name) + 1 :]) for n in done if n.startswith(f"{name}-") and n[len(name) + 1 :].isdigit())


def keep_batches(stream: DataFrame, summarize: Callable[[DataFrame], DataFrame], folder: str, name: str = "batch") -> DataFrame:
    """What ``summarize`` makes of every micro-batch, each in a table of its own: a replayed batch replaces what it wrote."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        summarize(batch).write.mode("overwrite").parquet(f"{folder}/{name}-{batch_id}")

    ingest(stream, write, f"{folder}/run")
    return spark.read.parquet(*(f"{folder}/{name}-{n}" for n in batches_of(spark, folder, name)))


def carry_voters(stream: DataFrame, folder: str, decay: float = 0.95) -> DataFrame:
    """Mass of each voter (voter, right) carried from batch to batch and faded; the state is a table per batch.

    A batch starts from the newest finished state before it, so a restart or a replay goes on where it was.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy("voter").agg(F.sum(F.col("right").cast("double")).alias("right"), F.count("*").cast("double").alias("mass"))
        before = [n for n in batches_of(spark, folder, "state") if n < batch_id]
        if before:
            old = spark.read.parquet(f"{folder}/state-{before[-1]}").select("voter", (F.col("right") * decay).alias("right"), (F.col("mass") * decay).alias("mass"))
            new = new.unionByName(old).groupBy("voter").agg(F.sum("right").alias("right"), F.sum("mass").alias("mass"))
        new.write.mode("overwrite").parquet(f"{folder}/state-{batch_id}")

    ingest(stream, step, folder)
    return spark.read.parquet(f"{folder}/state-{batches_of(spark, folder, 'state')[-1]}")


def bucket_transitions(stream: DataFrame, key: str, bucket: str) -> DataFrame:
    """(bucket, delta) rows as keys enter and leave buckets: a stateful operator that holds each key's last bucket.

    Rows of a key in a batch count in the order of ts and event_id.
    """

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        last = state.get[0] if state.exists else None
        first, now = last, rows[bucket].iloc[-1]
        state.update((now,))
        if first != now:
            yield pd.DataFrame({"bucket": [b for b in (first, now) if b is not None], "delta": [d for b, d in ((first, -1), (now, 1)) if b is not None]})

    return stream.groupBy(key).applyInPandasWithState(step, "bucket string, delta long", "bucket string", "append", "NoTimeout")
