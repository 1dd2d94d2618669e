"""The append ledger and the day grain on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.temporal import ledger

SHARDS = 256


def day_grain_stream(events: DataFrame, late: str = "1 day") -> DataFrame:
    """events(entity_id, ts, minutes) as entity-days; a day is given out once, when the watermark has passed it.

    Rows later than that are dropped, so that nothing already used as a prior day changes.
    """
    days = events.withWatermark("ts", late).groupBy("entity_id", F.window("ts", "1 day").alias("w"))
    return days.agg(F.count("*").alias("games"), F.avg("minutes").alias("minutes")).select("entity_id", F.to_date("w.start").alias("event_date"), "games", "minutes")


def capture(stream: DataFrame, path: str, checkpoint: str, digest: str = "digest", order: str = "seq") -> StreamingQuery:
    """Append each row of the stream to the ledger at path, duplicates marked and kept.

    duplicate_of names the first row with the digest, in this batch or an earlier one. A batch that is run again
    overwrites its own folder, so none is taken twice. The ledger lies in SHARDS folders by a hash of the digest; a batch
    reads only the folders that its own digests fall in.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.withColumn("shard", F.pmod(F.xxhash64(digest), F.lit(SHARDS)).cast("int"))
        rows = ledger(batch, digest, order).withColumn("duplicate_of", F.col("duplicate_of").cast("long"))
        if number:
            shards = [r.shard for r in batch.select("shard").distinct().collect()]  # SHARDS at most
            known = spark.read.schema(f"{digest} string, {order} long, outcome string, duplicate_of long, batch long, shard int").option("basePath", path).parquet(path)
            first = known.where(F.col("shard").isin(shards) & (F.col("batch") < number) & (F.col("outcome") == "SUCCESS")).select(F.col(digest), F.col(order).alias("_first"))
            rows = rows.join(first, digest, "left").withColumn("duplicate_of", F.coalesce("_first", "duplicate_of"))
            rows = rows.withColumn("outcome", F.when(F.col("duplicate_of").isNull(), "SUCCESS").otherwise("DUPLICATE")).drop("_first")
        rows.select(digest, order, "outcome", "duplicate_of", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
