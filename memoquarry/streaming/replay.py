"""Slot allocation over a stream of turns, its slots kept as state for each namespace."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupStateTimeout

from memoquarry.operators import replay as R
from memoquarry.shipping import ship
from memoquarry.sources.scratch import scratch_dir


def with_state(turns: DataFrame) -> DataFrame:
    """A streaming frame of turns -> a streaming frame of decisions."""
    ship(turns.sparkSession)

    def handle(key, frames, state):
        slots = R.load(state.get[0]) if state.exists else R.empty_slots()
        held = [f for f in frames if len(f)]
        if held:
            yield R.run(pd.concat(held), slots)
        state.update((R.dump(slots),))

    return R.features(turns).groupBy("conv_id").applyInPandasWithState(handle, R.OUT, "slots string", "append", GroupStateTimeout.NoTimeout)


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stream of the files in a folder, or of one file of it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())


def replay_stream(spark: SparkSession, path: str) -> DataFrame:
    """Run all files at ``path`` through the stateful operator and return its output table."""
    schema = spark.read.parquet(path).schema
    out = scratch_dir(spark, "replay")
    source = file_stream(spark, path, schema)
    job = with_state(source).writeStream.format("parquet").option("path", f"{out}/decisions").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    job.awaitTermination()
    return spark.read.schema(R.OUT).parquet(f"{out}/decisions")
