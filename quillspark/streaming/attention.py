"""Incremental ingest and live counts with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.matching import match_texts
from quillspark.operators.store import last_rows, upsert_into
from quillspark.session import new_folder


def ingest(spark: SparkSession, landing: str, schema: str, path: str, checkpoint: str, by: list[str], sort: list[str], order: str) -> StreamingQuery:
    """New landing files into the dataset at path, each record once: an upsert per batch, so that a replay changes nothing.

    Of the rows of one record in a batch that with the largest order stays.
    """
    arrived = spark.readStream.schema(schema).parquet(landing)

    def write(batch: DataFrame, _: int) -> None:
        upsert_into(batch.sparkSession, path, last_rows(batch, "record_id", order), by, sort, order=order)

    return arrived.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_counts(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Daily counts of a stream (ts): a day is final once the stream is `late` past its end."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", "1 day"), *keys).agg(F.count("*").alias("articles"))
    return counts.select(F.to_date("window.start").alias("day"), *keys, "articles")


def without_repeats(events: DataFrame, key: str = "record_id", late: str = "1 day") -> DataFrame:
    """Each key once, as long as its repeats are at most `late` apart."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def live_matches(articles: DataFrame, phrases: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes topic_id and url of each matched url of a stream of articles to path, once, against the static phrase table.

    What is known lies in the table at path, a folder for each batch, and each batch writes what the folders before it lack: the
    stream itself keeps no state, however long it runs, and a batch that is repeated replaces its folder by the same rows.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        topics = match_texts(batch, phrases.where("evidence_kind = 'topic'"))
        found = topics.select(F.col("dimension_id").alias("topic_id"), "url").distinct()
        try:
            known = spark.read.parquet(path).where(F.col("batch") < n)
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
        else:
            found = found.join(known, ["topic_id", "url"], "left_anti")
        found.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={n}")

    return articles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_url_counts(matched: DataFrame) -> DataFrame:
    """Distinct matched urls per topic of what live_matches wrote: exact, however late the rows came."""
    return matched.groupBy("topic_id").agg(F.count_distinct("url").alias("urls"))


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming plan over what has arrived and returns its rows: for append those of all batches, for complete the last result.

    Rows, state and offsets go to a new folder under spark.checkpoint.dir; the driver holds none of the rows.
    """
    spark = stream.sparkSession
    top, last = new_folder(spark, "live"), []

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/rows/batch={n}")  # a repeated batch replaces itself
        last.append(n)

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{top}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], stream.schema)
    paths = [f"{top}/rows/batch={n}" for n in sorted(set(last))]
    return spark.read.schema(stream.schema).parquet(*(paths if mode == "append" else paths[-1:]))
