"""Streams: polled ingestion of papers with status updates, and event-time aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators.tabular import first_seen, update_by_key
from knotwork.session import stage_table


def watch(spark: SparkSession, path: str, kind, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they land in a folder."""
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


class Table:
    """A keyed Parquet table of versions: inserts of unknown keys and updates by key, safe to repeat per batch."""

    def __init__(self, spark: SparkSession, path: str, key: str) -> None:
        self.spark, self.path, self.key = spark, path, key

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def read(self) -> DataFrame | None:
        """The newest version of every key."""
        if not self._exists():
            return None
        rows = self.spark.read.parquet(self.path)
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), "_version").alias("_")).select(self.key, "_.*")
        return newest.drop("_version", "_batch")

    def compact(self) -> None:
        """Leave only the newest version of every key, so later reads and inserts follow the number of keys."""
        rows = self.spark.read.parquet(self.path)
        newest = stage_table(rows.groupBy(self.key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != self.key)), "_version").alias("_")).select(self.key, "_.*"), "compact")
        newest.select(*rows.columns).write.mode("overwrite").parquet(self.path)

    def insert(self, rows: DataFrame, order: list[str], batch: int) -> None:
        """Insert keys that are not there, the first row of each; a batch that was written before adds nothing."""
        new = first_seen(rows.filter(F.col(self.key).isNotNull()), [self.key], order)
        if self._exists():
            new = new.join(self.spark.read.parquet(self.path).select(self.key), self.key, "left_anti")
        new.withColumn("_version", F.lit(batch * 2)).withColumn("_batch", F.lit(batch)).write.mode("append").parquet(self.path)

    def update(self, changes: DataFrame, batch: int) -> None:
        """New versions of the keys that are changed."""
        now = self.read()
        if now is not None:
            hit = now.join(changes.select(self.key), self.key, "left_semi")
            update_by_key(hit, changes, self.key).withColumn("_version", F.lit(batch * 2 + 1)).withColumn("_batch", F.lit(batch)).write.mode("append").parquet(self.path)


def ingest(stream: DataFrame, target: Table, order: list[str], checkpoint: str, framework: str = "tf", work: Callable[[DataFrame], DataFrame] | None = None, every: str | None = None) -> StreamingQuery:
    """Insert papers of a framework as they arrive; ``work`` gives (key, status columns) of new papers to update.

    With ``every`` the source is polled in that interval, otherwise everything there is taken and the query ends.
    """

    def step(rows: DataFrame, batch: int) -> None:
        rows = rows.filter(F.contains("framework", F.lit(framework))).persist()
        target.insert(rows, order, batch)
        if work is not None:
            target.update(work(first_seen(rows, [target.key], order)), batch)
        rows.unpersist()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(step)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def attempted(rows: DataFrame, key: str, run: Callable[[dict], None], columns: list[str]) -> DataFrame:
    """(key, status, err_msg): what became of each row when ``run`` was called with it as a dictionary.

    An error of one row is its message and stops no other; rows are handled in Arrow batches where they lie.
    """
    kind = dict(rows.dtypes)[key]

    def task(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                try:
                    run(row)
                    out.append((row[key], "success", None))
                except Exception as e:  # noqa: BLE001
                    out.append((row[key], "error", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=[key, "status", "err_msg"])

    return rows.select(*dict.fromkeys([key, *columns])).mapInPandas(task, f"{key} {kind}, status string, err_msg string")


def report(target: Table, column: str, send: Callable[[list[tuple]], None] | None, most: int = 1000) -> list[tuple]:
    """Rows per value of a column of the table, largest first; they are also sent where a callback is given. Off by default."""
    rows = target.read()
    counts = [] if rows is None else [tuple(r) for r in rows.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(most).collect()]
    if send is not None and counts:
        send(counts)
    return counts


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their values per window and type; late events beyond ``late`` are left out in a stream."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of users, parted by a gap without events."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event_id once; in a stream within the watermark, so state stays bounded."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else first_seen(events, ["event_id"], ["ts"])
