"""Incremental work as streams: new inputs only, one output per entity, replays change nothing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from voxelmetry.operators.distribution import quantiles


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """New files of a folder as a stream with a declared schema."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return (r.option("pathGlobFilter", glob) if glob else r).format(fmt).load(folder)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> int:
    """Processes what is there and stops; the checkpoint remembers how far it got.

    Returns how many rows came too late for the watermark and were dropped.
    """
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
    operators = [o for p in q.recentProgress for o in p["stateOperators"]]
    return sum(o["numRowsDroppedByWatermark"] for o in operators)


def write_batch(df: DataFrame, out: str, batch: int) -> None:
    """One folder per batch, overwritten by a replay of the same batch: the manifest may lag, work is never lost
    or doubled."""
    df.write.mode("overwrite").parquet(f"{out}/batch={batch}")


def score_new_entities(stream: DataFrame, entity: str, sums: Mapping[str, Column], finish: Mapping[str, Column], out: str, checkpoint: str) -> DataFrame:
    """One output per entity from all its rows so far, each row read once.

    ``sums`` are additive measures of a row (or other mergeable aggregates, given as such); the stream keeps them as
    state, one small record for each entity, so that a batch costs what its own rows cost. ``finish`` turns the sums of an
    entity into its scores. Batches bring only the entities that have new rows, and the result does not depend on how
    rows fall into batches. A replayed batch overwrites its own output.
    """
    kept = stream.groupBy(entity).agg(*[c.alias(n) for n, c in sums.items()])
    scored = kept.select(entity, *[c.alias(n) for n, c in finish.items()])
    run_available(scored, lambda rows, batch: write_batch(rows, out, batch), checkpoint, "update")
    return latest(stream.sparkSession, out, [entity])


class HistogramState(StatefulProcessor):
    """Counts of an entity's values per bin: mergeable state from which any quantile of all rows so far follows, to a bin."""

    def __init__(self, entity: str, value: str, low: float, high: float, bins: int, qs: Mapping[str, float]):
        self.entity, self.value, self.low, self.high, self.bins, self.qs = entity, value, low, high, bins, dict(qs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "counts ARRAY<BIGINT>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        counts = np.array(self.counts.get()[0]) if self.counts.exists() else np.zeros(self.bins, np.int64)
        for part in rows:
            at = np.floor((part[self.value].dropna().to_numpy(float) - self.low) / (self.high - self.low) * self.bins).astype(int)
            counts = counts + np.bincount(np.clip(at, 0, self.bins - 1), minlength=self.bins)
        self.counts.update((counts.tolist(),))
        n, upto = int(counts.sum()), np.cumsum(counts)
        width = (self.high - self.low) / self.bins
        found = {name: [self.low + width * (np.searchsorted(upto, q * max(n - 1, 0), "right") + 0.5) if n else None] for name, q in self.qs.items()}
        yield pd.DataFrame({self.entity: [key[0]], "n": [n], **found})

    def close(self) -> None:
        pass


def running_quantiles(stream: DataFrame, entity: str, value: str, low: float, high: float, bins: int, qs: Mapping[str, float]) -> DataFrame:
    """Quantiles of each entity over all its rows so far, to half a bin of [low, high); state is ``bins`` counts an entity.

    Needs the RocksDB state store (``state_store`` sets it).
    """
    kind = stream.schema[entity].dataType.simpleString()
    schema = f"`{entity}` {kind}, n BIGINT, " + ", ".join(f"`{q}` DOUBLE" for q in qs)
    rows = stream.select(entity, F.col(value).cast("double").alias(value)).groupBy(entity)
    return rows.transformWithStateInPandas(HistogramState(entity, value, low, high, bins, qs), schema, "Update", "None")


def state_store(spark: SparkSession) -> None:
    """Keeps streaming state in RocksDB on the executors and in the checkpoint folder, as custom state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(spark: SparkSession, out: str, key: Sequence[str]) -> DataFrame:
    """The newest row per key of an update-mode result written batch by batch."""
    df = spark.read.parquet(out)
    rest = [c for c in df.columns if c not in (*key, "batch")]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*key, "r.*")


def progress(stream: DataFrame, ts: str, value: str, width: str = "5 seconds", delay: str = "1 minute") -> DataFrame:
    """Count and minimum per tumbling window; state older than the delay is dropped."""
    w = stream.withWatermark(ts, delay).groupBy(F.window(ts, width))
    return w.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low")).select(F.col("window.start").alias("start"), "n", "low")


def running_summary(stream: DataFrame, by: Sequence[str], value: str, below: float = 0.8) -> DataFrame:
    """Counts and mean per status as records arrive. State is one row per group."""
    return stream.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.count(F.when(F.col(value) < below, 1)).alias("n_below"))


def record_summary(spark: SparkSession, records: str, by: Sequence[str], value: str) -> DataFrame:
    """Exact medians over all stored records: recomputed from the table, as quantile state would be unbounded."""
    return quantiles(spark.read.parquet(records).drop("batch"), value, {"median": 0.5, "p5": 0.05}, by)


def first_occurrences(stream: DataFrame, ts: str, digest: Column, delay: str) -> DataFrame:
    """Rows whose content was not seen within the delay."""
    return stream.withColumn("digest", digest).withWatermark(ts, delay).dropDuplicatesWithinWatermark(["digest"])
