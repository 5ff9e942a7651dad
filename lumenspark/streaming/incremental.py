"""Incremental scoring: tiles that arrive as Parquet files are scored once each.

Input may repeat (at least once).  Which models have a prediction of which tiles is kept as state of the stream
by source image, so a batch reads the files that have arrived and their sources' state, never what was scored
before, and tiles of a source that arrive together are scored in stacks.  A tile that failed is tried again when it arrives again.  A batch of the stream is a batch of the
scoring folder under the stream's number: after a crash it is scored again from the state before it and
written anew.  For many tiles, give the session the RocksDB state store, which keeps state on disk.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenspark.operators.scoring import RESULT, SCORERS, check_models, score_rows
from lumenspark.sources.commits import write_batch
from lumenspark.sources.images import PAYLOAD


def score_arrivals(spark: SparkSession, arrivals: str, models: list[str], folder: str, progress: str, scorers: dict[str, Callable] | None = None) -> None:
    """Take all files that have come since the last call, then stop; models are fixed for a stream's progress folder."""
    scorers = scorers or SCORERS
    check_models(models, scorers)
    columns = ["source_filename", "tile_filename", "magnification", *[f.split()[0] for f in PAYLOAD.split(", ")]]
    built: dict = {}

    def once(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        done = {tuple(pair) for pair in json.loads(state.get[0])} if state.exists else set()
        met: set = set()  # a batch may hold copies
        for frame in frames:
            rows = [row for row in frame.itertuples(index=False) if row.tile_filename not in met and not met.add(row.tile_filename)]
            left = [(row, m) for row in rows for m in models if (row.tile_filename, m) not in done]
            if left:
                made = score_rows(built, scorers, *map(list, zip(*left, strict=True)))
                good = made[made["status"] == "ok"]
                done |= set(zip(good["tile_filename"], good["model"], strict=True))
                yield made
        state.update((json.dumps(sorted(done, key=str)),))

    def batch(made: DataFrame, number: int) -> None:
        write_batch(made.withColumn("timestamp", F.current_timestamp()), folder, f"stream-{number:010d}")

    stream = spark.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals).select(*columns)
    scored = stream.groupBy("source_filename").applyInPandasWithState(once, RESULT, "done string", "append", GroupStateTimeout.NoTimeout)
    query = scored.writeStream.foreachBatch(batch).outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start()
    query.awaitTermination()
