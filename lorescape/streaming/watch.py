"""Watching a folder: each trigger compares a full listing with the last one, so that deletions are seen, too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lorescape.operators.durable import Kept, written
from lorescape.operators.store import snapshot_diff
from lorescape.sources.markdown import listing

INTERVAL = "2 seconds"


def snapshot(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime) of the Markdown files; their contents aren't read."""
    return listing(spark, root).select("path", "mtime")


class Watcher:
    """Calls on_change(changes) whenever a listing differs from the last one. The first listing is the start.

    Listings are tables in the shared folder, of which the last one is kept; they don't come to the driver.
    """

    def __init__(self, spark: SparkSession, root: str, on_change: Callable[[DataFrame], None]):
        self.spark, self.root, self.on_change = spark, root, on_change
        self.last = Kept(snapshot(spark, root))

    def poll(self) -> bool:
        now = Kept(snapshot(self.spark, self.root))
        with written(snapshot_diff(self.last.rows, now.rows)) as changes:
            if changes.isEmpty():
                now.drop()
                return False
            try:
                self.on_change(changes)
            except BaseException:
                now.drop()  # a change whose handling failed is seen again
                raise
        self.last.drop()
        self.last = now
        return True

    def start(self, interval: str = INTERVAL) -> StreamingQuery:
        """Polls at an interval until the query is stopped."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.trigger(processingTime=interval).foreachBatch(lambda _df, _id: self.poll() and None).start()
