"""Running streams over all that is there, and closing them by a clock."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the clock stands when a stream is closed.
CLOSED_AT = "2200-01-01 00:00:00"
_STORE, _ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass
class Drained:
    """rows: all that a stream has given so far. batches: for each micro-batch of this run rows_in, and rows_kept and rows_late of its state."""

    rows: DataFrame
    batches: list[dict[str, int]]


def _batches(query) -> list[dict[str, int]]:
    out = []
    for p in query.recentProgress:
        states = p.stateOperators
        out.append({"rows_in": p.numInputRows, "rows_kept": sum(x.numRowsTotal for x in states), "rows_late": sum(x.numRowsDroppedByWatermark for x in states)})
    return out


def drain(stream: DataFrame, path: str) -> Drained:
    """Runs a stream over all that is there, in append mode, into Parquet below path; a later run with the same path goes on where this one ended."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE)
    spark.conf.set(_STORE, _ROCKS)  # state with timers needs it
    try:
        query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(_STORE, before)
    return Drained(spark.read.schema(stream.schema).parquet(f"{path}/rows"), _batches(query))


def with_clock(stream: DataFrame, path: str) -> DataFrame:
    """The stream and the rows of a clock, which only have a timestamp.

    Event time stands still where no rows come; set_clock() moves it on, so that what waits for the watermark comes out.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], "timestamp timestamp").write.mode("ignore").parquet(f"{path}/clock")
    return stream.unionByName(spark.readStream.schema("timestamp timestamp").parquet(f"{path}/clock"), allowMissingColumns=True)


def set_clock(spark: SparkSession, path: str, at: str = CLOSED_AT) -> None:
    spark.range(1).select(F.lit(at).cast("timestamp").alias("timestamp")).write.mode("append").parquet(f"{path}/clock")


def close(stream: DataFrame, path: str, operator: Callable[[DataFrame], DataFrame]) -> Drained:
    """All rows of operator(stream) once the stream has ended: runs over all that is there, moves the clock past every wait, and runs again."""
    out = operator(with_clock(stream, path))
    first = drain(out, path)
    set_clock(stream.sparkSession, path)
    last = drain(out, path)
    return Drained(last.rows, first.batches + last.batches)
