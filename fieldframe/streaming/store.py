"""A table of per-frame results that micro-batches update by frame (STR1, STR2).

    data/version=<batch>     the frames that a batch touched, merged with what they held before
    ledger/batch=<batch>     (key, version) of every frame as of that batch, written last, in one file

A batch starts from the ledger before it, so a repeated batch finds the same state and replaces what an earlier attempt
wrote; a reader follows the newest ledger and so never sees half a batch. Every ``COMPACT`` batches all frames are
written anew: a reader opens at most that many versions, however long the stream has run. Older folders may be removed by age.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldframe.session import materialize

#: Batches between two versions that hold all frames.
COMPACT = 50

Step = Callable[[DataFrame], DataFrame]


class FrameStore:
    """Results by ``key``; ``merge`` re-aggregates the union of what is stored and what is new."""

    def __init__(self, spark: SparkSession, path: str, merge: Step, key: str = "frame") -> None:
        self.spark, self.path, self.merge, self.key = spark, path.rstrip("/"), merge, key

    def _newest(self, before: int | None) -> int | None:
        """The newest ledger, of those before a batch if one is given; only names are listed."""
        try:
            names = self.spark.read.option("recursiveFileLookup", True).format("binaryFile").load(f"{self.path}/ledger").inputFiles()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        batches = {int(m[1]) for n in names if (m := re.search(r"/batch=(\d+)/[^/]*\.parquet$", n))}
        return max((b for b in batches if before is None or b < before), default=None)

    def ledger(self, before: int | None = None) -> DataFrame | None:
        """(key, version) of all frames, None before the first batch."""
        newest = self._newest(before)
        return None if newest is None else self.spark.read.parquet(f"{self.path}/ledger/batch={newest}")

    def read(self, before: int | None = None) -> DataFrame | None:
        """The rows of all frames, None before the first batch."""
        ledger = self.ledger(before)
        if ledger is None:
            return None
        live = sorted(r[0] for r in ledger.select("version").distinct().collect())
        rows = self.spark.read.option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/version={v}" for v in live])
        named = ledger.select(F.struct(self.key).alias("_key"), F.col("version").cast("long").alias("version"))
        return (rows.withColumn("version", F.col("version").cast("long")).withColumn("_key", F.struct(self.key))
                .join(named, ["_key", "version"], "left_semi").drop("_key", "version"))

    def apply(self, fresh: DataFrame, batch: int) -> None:
        """Merge the partial results of a batch into the frames that they touch."""
        fresh = materialize(fresh, "partial")
        stored, ledger = self.read(batch), self.ledger(batch)
        keys = fresh.select(F.struct(self.key).alias("_key")).distinct()
        union = fresh
        if stored is not None:
            whole = batch % COMPACT == COMPACT - 1
            held = stored if whole else stored.withColumn("_key", F.struct(self.key)).join(keys, "_key", "left_semi").drop("_key")
            union = held.unionByName(fresh)
        here = f"{self.path}/data/version={batch}"
        self.merge(union).write.mode("overwrite").parquet(here)
        now = self.spark.read.parquet(here).select(self.key).distinct().withColumn("version", F.lit(batch).cast("long"))
        if ledger is not None:
            rest = ledger.withColumn("_key", F.struct(self.key)).join(now.select(F.struct(self.key).alias("_key")), "_key", "left_anti").drop("_key")
            now = now.unionByName(rest.withColumn("version", F.col("version").cast("long")))
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/ledger/batch={batch}")

    def follow(self, stream: DataFrame, partial: Step, checkpoint: str, available_now: bool = True,
               interval: str = "1 minute") -> StreamingQuery:
        """Start a query that applies ``partial`` of every batch.

        With ``available_now`` it processes what is there and stops; started again with the same
        checkpoint it goes on with the files that came since (STR2).
        """
        writer = (stream.writeStream.option("checkpointLocation", checkpoint)
                  .foreachBatch(lambda rows, batch: self.apply(partial(rows), batch)))
        trigger = {"availableNow": True} if available_now else {"processingTime": interval}
        return writer.trigger(**trigger).start()
