"""Per-frame summaries and histograms over a stream of frame files (STR1, STR2).

Each micro-batch is reduced to partial sums that can be merged. ``store.FrameStore`` merges them by frame as
they come, for streams that go on; ``accumulate`` keeps the partials of each batch apart under its number, for
runs of few batches whose parts are wanted. A restart from the checkpoint neither loses nor repeats rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from fieldframe.functions import constants as C
from fieldframe.operators.binning import fill_bins, log_bin

Partial = Callable[[DataFrame], DataFrame]


def read_frames(spark: SparkSession, path: str, schema: StructType, pattern: str = "*.parquet",
                files_per_batch: int = 1000) -> DataFrame:
    """Stream of the rows of new Parquet files below a folder."""
    return (spark.readStream.schema(schema).option("pathGlobFilter", pattern)
            .option("maxFilesPerTrigger", files_per_batch).parquet(path))


def accumulate(stream: DataFrame, partial: Partial, out: str, checkpoint: str,
               available_now: bool = True, interval: str = "1 minute") -> StreamingQuery:
    """Start a query that writes ``partial(batch)`` to ``out/batch=<id>`` (STR1).

    With ``available_now`` it processes what is there and stops; started again with the same
    checkpoint it goes on with the files that came since (STR2).
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def histogram_partial(pmin: float = 0.01, pmax: float = 10.0, bins: int = 128) -> Partial:
    """Partial momentum histogram per frame; frames without counted rows keep a NULL bin."""
    def run(batch: DataFrame) -> DataFrame:
        active = F.col("status") == C.STATUS_ACTIVE
        binned = batch.select("frame", F.when(active, log_bin(F.col("p"), pmin, pmax, bins)).alias("bin"), "weight")
        return binned.groupBy("frame", "bin").agg(F.sum("weight").alias("weight"))
    return run


def merge_histogram(partials: DataFrame) -> DataFrame:
    """Partial histograms as one."""
    return partials.groupBy("frame", "bin").agg(F.sum("weight").alias("weight"))


def merged_histogram(partials: DataFrame, bins: int = 128) -> DataFrame:
    """Histogram of all batches so far, all bins present."""
    return fill_bins(merge_histogram(partials), ["frame"], bins)


def summary_partial(batch: DataFrame) -> DataFrame:
    """Mergeable sums and extremes of the frame summary."""
    active = F.col("status") == C.STATUS_ACTIVE
    p = F.when(active, F.col("p"))
    return batch.groupBy("frame").agg(
        F.count(F.lit(1)).alias("stored"), F.count(p).alias("active"),
        F.sum(F.when(active, F.col("weight"))).alias("weight_sum"), F.sum(p).alias("p_sum"),
        F.min(p).alias("p_min"), F.max(p).alias("p_max"))


def merge_summary(partials: DataFrame) -> DataFrame:
    """Partial summaries as one."""
    sums, least, most = ("stored", "active", "weight_sum", "p_sum"), F.min("p_min"), F.max("p_max")
    return partials.groupBy("frame").agg(*[F.sum(c).alias(c) for c in sums], least.alias("p_min"), most.alias("p_max"))


def merged_summary(partials: DataFrame) -> DataFrame:
    """Frame summary of all batches so far."""
    zero = F.lit(0.0)
    total = merge_summary(partials).withColumnRenamed("p_sum", "_p").withColumns(
        {c: F.coalesce(c, zero) for c in ("weight_sum", "p_min", "p_max")})
    mean = F.when(F.col("active") > 0, F.col("_p") / F.when(F.col("active") > 0, F.col("active")))
    return total.withColumns({"inactive": F.col("stored") - F.col("active"),
                              "p_avg": F.coalesce(mean, F.lit(0.0))}).drop("_p")
