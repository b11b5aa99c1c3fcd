"""Responses that keep arriving: shredded into answer atoms once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortspark.functions.text import bare_identifier
from cohortspark.operators.identifier_index import IdentifierIndex, hashes
from cohortspark.operators.response_atoms import answer_atoms
from cohortspark.operators.storage import stored
from cohortspark.sources.study_files import response_schema


def response_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """Questionnaire responses from a folder of JSON lines, new files only."""
    return spark.readStream.schema("rec_no bigint, " + response_schema()).option("maxFilesPerTrigger", files_per_trigger).json(path)


def windowed_counts(stream: DataFrame, late: str = "2 days", window: str = "1 hour") -> DataFrame:
    """Responses by status in windows of ``authored``; those later than ``late`` behind the newest are dropped."""
    timed = stream.withColumn("at", F.try_to_timestamp("authored")).where("at is not null").withWatermark("at", late)
    return timed.groupBy(F.window("at", window), F.coalesce("status", F.lit("completed")).alias("status")).agg(F.count("*").alias("n")).select("window.start", "window.end", "status", "n")


def ingest_atoms(spark: SparkSession, stream: DataFrame, target: str, checkpoint: str, index: IdentifierIndex | None = None) -> StreamingQuery:
    """Appends the answer atoms of responses not seen before to ``target/batch=N`` and ends when all there is has been read.

    A response is known by its identifier, looked up in a persistent index (by default beside the checkpoint, so it is
    found again after a restart); one without identifier is always new. A batch that is run again after a failure
    is looked up in earlier batches only and overwrites its own folder, so nothing is lost and nothing comes twice.
    """
    index = index or IdentifierIndex(spark, f"{checkpoint.rstrip('/')}-index")

    def take(batch: DataFrame, number: int) -> None:
        keyed = stored(batch.withColumn("bare", bare_identifier(F.col("id"))).withColumns(dict(zip(("h1", "h2"), hashes(F.col("bare")), strict=True))), "stream-batch")
        named = keyed.where("bare is not null")
        found = index.absorb(named.select("h1", "h2", F.col("rec_no").alias("owner")), number)
        fresh = found.where("first_owner is null").select("h1", "h2", F.col("owner").alias("rec_no"))
        new = named.join(fresh, ["h1", "h2", "rec_no"], "left_semi").dropDuplicates(["h1", "h2"])
        rows = keyed.where("bare is null").unionByName(new).drop("bare", "h1", "h2")
        answer_atoms(rows).write.mode("overwrite").parquet(f"{target}/batch={number}")
        index.drop_found(number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
