"""Activity as a stream: hourly windows, sessions, new ids, grown comment counts, and upserts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..store import shared_folder


def read_activity(spark: SparkSession, folder: str, schema: str, name: str = "*.parquet", time: str = "ts") -> DataFrame:
    """Files of a folder as a stream with event times."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn(time, F.col(time).cast("timestamp"))


def tumbling(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sliding(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "6 hours", step: str = "15 minutes") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, key: str, time: str = "ts", late: str = "1 hour", gap: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def new_only(stream: DataFrame, key: str = "id", time: str = "ts", late: str = "7 days") -> DataFrame:
    """Rows whose key was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def grown(stream: DataFrame, key: str = "id", count: str = "comment_count") -> DataFrame:
    """Keys whose count grew since they were last seen, with both counts; the state is one number for each key."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        now = max([before, *(int(f[count].max()) for f in frames)])
        state.update((now,))
        if now > before:
            yield pd.DataFrame({key: [k[0]], "before": [before], "now": [now]})

    typed = stream.select(F.col(key).cast("string").alias(key), F.col(count).cast("long").alias(count))
    return typed.groupBy(key).applyInPandasWithState(step, f"{key} string, before long, now long", "n long", "append", GroupStateTimeout.NoTimeout)


BUCKETS = 32


def _pointer(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each bucket of a table; empty where there is no table yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return {}
    stream = fs.open(target)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, folders: dict[str, str]) -> None:
    """Replace the pointer in one step."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, current = (jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in (f"_next-{uuid.uuid4().hex}", "_current"))
    out = new.getFileSystem(conf).create(new, True)
    try:
        out.write(json.dumps(folders).encode())
    finally:
        out.close()
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(kinds, 1)
    how[0] = kinds.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.getFileSystem(conf).getUri(), conf).rename(new, current, how)


def upsert(batch: DataFrame, path: str, key: str, version: str) -> None:
    """Merge a micro-batch into a table of Parquet buckets by key: the latest row of each key wins.

    Only the buckets that the batch touches are written, beside the old ones; a pointer file then names the new ones in one step, so
    a failed batch leaves the table as it was, and a batch that is run again gives the same table.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(BUCKETS)).cast("int")
    batch = batch.persist()
    try:
        folders = _pointer(spark, path)
        touched = [str(r[0]) for r in batch.select(bucket).distinct().collect()]  # at most BUCKETS rows
        old = [folders[b] for b in touched if b in folders]
        rows = spark.read.schema(batch.schema).parquet(*old).unionByName(batch) if old else batch
        rank, part = (name + "_" * sum(c.lower().startswith(name) for c in batch.columns) for name in ("rank", "bucket"))
        last = rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).filter(F.col(rank) == 1).drop(rank)
        made = f"{path}/{uuid.uuid4().hex}"
        last.withColumn(part, bucket).repartition(F.col(part)).write.partitionBy(part).parquet(made)
        _point(spark, path, folders | {b: f"{made}/{part}={b}" for b in touched})
    finally:
        batch.unpersist()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`upsert` keeps."""
    return spark.read.parquet(*_pointer(spark, path).values())


def run_available(stream: DataFrame, mode: str = "complete", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Run a stream over all that is there now; its result table, or None where ``each`` takes the batches."""
    spark = stream.sparkSession
    folder, last = shared_folder(spark, "stream-result"), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/{number}")
        last[:] = [number]

    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", shared_folder(spark, "stream"))
    writer.foreachBatch(each or keep).start().awaitTermination()
    if each:
        return None
    return spark.read.schema(stream.schema).parquet(f"{folder}/{last[0]}") if last else spark.createDataFrame([], stream.schema)


def due(last_run_seconds_ago: float | None, minutes: float) -> bool:
    """True if a job never ran or ran longer ago than its interval."""
    return last_run_seconds_ago is None or last_run_seconds_ago > 60 * minutes


# Least minutes between runs of each job of a cycle.
SCHEDULE = {
    "sync_status": 30, "trending_agents": 15, "conversation_clusters": 30, "network_centrality": 60, "anomalies": 20, "content_gaps": 120, "hot_topics": 30,
    "duplicates": 60, "spam_scores": 30, "author_influence": 45, "topic_graph": 30, "ic_matrices": 120, "ic_fingerprints": 60, "ic_coordination": 30,
    "ic_graph_metrics": 90, "ic_communities": 60, "ic_temporal": 45, "ic_narratives": 120, "ic_alerts": 10, "ic_alert_summary": 10,
}
