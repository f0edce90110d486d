"""Incremental graph building: triples arrive as files, each micro-batch is folded into the edge state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from juristrata.operators.graph import STATE, edge_state, merge_states


class EdgeStore:
    """The edge state as versioned Parquet folders under a path: version n is the fold of batches up to n.

    A batch that runs again after a failure writes its version anew from the version before, so replays do not count
    twice. Older versions are kept for as long as `keep` says."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _fs(self):
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        fs, root = self._fs()
        if not fs.exists(root):
            return []
        done = [p.getPath() for p in fs.listStatus(root)]
        marker = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(int(p.getName().split("=")[1]) for p in done if p.getName().startswith("version=") and fs.exists(marker(p, "_SUCCESS")))

    def read(self, before: int | None = None) -> DataFrame:
        found = [v for v in self.versions() if before is None or v < before]
        return self.spark.read.schema(STATE).parquet(f"{self.path}/version={found[-1]}") if found else self.spark.createDataFrame([], STATE)

    def fold(self, batch: DataFrame, batch_id: int) -> None:
        merge_states(self.read(before=batch_id), edge_state(batch)).write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")
        fs, _ = self._fs()
        for old in [v for v in self.versions() if v <= batch_id][: -self.keep]:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={old}"), True)


def accumulate(triples: DataFrame, store: EdgeStore, checkpoint: str) -> StreamingQuery:
    """Fold a streaming DataFrame of triples into the store, taking all that is there and then stopping."""
    return triples.writeStream.foreachBatch(store.fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unprocessed(chunks: DataFrame, ledger: DataFrame) -> DataFrame:
    """Chunks not in the ledger of processed ids; unlike resuming by triples, chunks that gave none are not redone."""
    return chunks.join(ledger.select("id").distinct(), "id", "left_anti")


def windowed_edges(triples: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Edges counted by event-time windows (column ts), with a watermark for late triples; for batch or stream."""
    return triples.withWatermark("ts", late).groupBy(F.window("ts", width).alias("window"), "source_id", "action_type", "target").agg(F.count(F.lit(1)).alias("times_seen"))
